"""Cleaning of an article's tree: what is taken out, by what an element holds and what its names say."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pagelift.functions import matchers
from pagelift.functions.text import inner_length, trim, utf16
from pagelift.sources.html import ELEMENT, TEXT, Node, serialize

from .dom import below, drop, element, elements, following, get, holds_only, is_phrasing, link_share, next_sibling, only_element, past_blank, put, remove_and_follow, remove_each, retag, text, under

# Limits and element names of the cleaning rules.
SHARE_LENGTH = 500
TINY_IMAGE = 133
PRESENTATIONAL = frozenset("align background bgcolor border cellpadding cellspacing frame hspace rules style valign vspace".split())
SIZED = frozenset(("table", "th", "td", "hr", "pre"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DATA_PARTS = frozenset("col colgroup tfoot thead th".split())
EMBEDDED = frozenset(("object", "embed", "iframe"))

_IMAGE, _IMAGE_SET, _IMAGE_ALONE = (re.compile(p) for p in (matchers.IMAGE, matchers.IMAGE_SET, matchers.IMAGE_ALONE))
_BASE64 = re.compile(r"^data:[ \t\n\r\f]*([^ \t\n\r\f;,]+)[ \t\n\r\f]*;[ \t\n\r\f]*base64[ \t\n\r\f]*,", re.IGNORECASE)
_WHOLE = re.compile(r"[+-]?[0-9]+\Z")


@dataclass
class Rules:
    """What cleaning depends on in an attempt."""

    video: re.Pattern
    density_modifier: float
    weigh_classes: bool
    conditional: bool
    data_tables: set[Node]

    def weight(self, n: Node) -> int:
        return matchers.class_weight(get(n, "class"), get(n, "id")) if self.weigh_classes else 0


def clean_styles(n: Node) -> None:
    todo = [n]
    while todo:
        x = todo.pop()
        if x.tag == "svg":
            continue
        if x.attrs:
            plain = lambda k: k if k.isascii() else k.lower().replace("ſ", "s")
            x.attrs = [a for a in x.attrs if plain(a[0]).lower() not in PRESENTATIONAL and not (x.tag in SIZED and plain(a[0]).lower() in ("width", "height"))]
        todo.extend(elements(x))


def _span(n: Node, name: str) -> int:
    """A whole number kept within 64 bits; what is none, and 0, is 1."""
    value = get(n, name)
    if not _WHOLE.match(value):
        return 1
    size = value.lstrip("+-").lstrip("0")[:20] or "0"  # 20 digits are beyond 64 bits, whatever follows
    return max(-(2**63), min(2**63 - 1, -int(size) if value[0] == "-" else int(size))) or 1


def table_size(table: Node) -> tuple[int, int]:
    """Rows and columns, with those of tables inside; spans that are no whole number count one."""
    rows = below(table, "tr")
    return sum(_span(r, "rowspan") for r in rows), max([0, *(sum(_span(c, "colspan") for c in below(r, "td")) for r in rows)])


def is_data_table(table: Node) -> bool:
    if get(table, "role") == "presentation" or get(table, "datatable") == "0":
        return False
    if get(table, "summary"):
        return True
    inside = below(table)
    if any(x.tag == "caption" and x.children for x in inside) or any(x.tag in DATA_PARTS for x in inside):
        return True
    if any(x.tag == "table" for x in inside):
        return False
    rows, columns = table_size(table)
    return rows >= 10 or columns > 4 or rows * columns > 10


def lazy_images(article: Node) -> None:
    """Images that wait for a script get their source from the attribute that names one."""
    for n in below(article, "img", "picture", "figure"):
        source = get(n, "src")
        m = _BASE64.match(source) if source else None
        if m:
            if m.group(1) == "image/svg+xml":
                continue
            if any(k != "src" and _IMAGE.search(v) for k, v in n.attrs) and utf16(source[m.end() :]) < TINY_IMAGE:
                drop(n, "src")
        if (get(n, "src") or get(n, "srcset") not in ("", "null")) and "lazy" not in get(n, "class").lower():
            continue
        i = 0
        while i < len(n.attrs):  # attributes that are added are looked at, too
            key, value = n.attrs[i]
            i += 1
            if key in ("src", "srcset", "alt"):
                continue
            to = "srcset" if _IMAGE_SET.search(value) else "src" if _IMAGE_ALONE.search(value) else ""
            if to and n.tag in ("img", "picture"):
                put(n, to, value)
            elif to and not below(n, "img", "picture"):
                n.append(element("img", **{to: value}))


def clean(article: Node, tag: str, video: re.Pattern) -> None:
    remove_each(below(article, tag), lambda n: tag not in EMBEDDED or not any(video.search(v) for _, v in n.attrs))


@dataclass
class Holdings:
    """What an element holds, for the conditional rules."""

    paragraphs: int = 0
    images: int = 0
    items: int = 0
    inputs: int = 0
    embeds: int = 0
    commas: int = 0
    length: int = 0
    heading_length: int = 0
    list_length: int = 0
    link_density: float = 0.0
    video: bool = False


def holdings(n: Node, video: re.Pattern) -> Holdings:
    """Counts and lengths of what is below an element, from one walk; texts of parts are slices of its own."""
    out, pieces, at, parts = Holdings(), [], 0, []
    todo: list[Node | list] = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, list):  # the end of a part
            x[2] = at
            continue
        if x.kind == TEXT:
            pieces.append(x.text)
            at += len(x.text)
            continue
        if x is not n and x.kind == ELEMENT:
            tag = x.tag
            out.paragraphs += tag == "p"
            out.images += tag == "img"
            out.items += tag == "li"
            out.inputs += tag == "input"
            if tag in EMBEDDED:
                out.embeds += 1
                out.video = out.video or any(video.search(v) for _, v in x.attrs) or tag == "object" and video.search(serialize(x.children)) is not None
            if tag in HEADINGS or tag in ("ul", "ol", "a"):
                part = [x, at, at]
                parts.append(part)
                todo.append(part)
        todo.extend(reversed(x.children))
    whole = "".join(pieces)
    out.commas, out.length = whole.count(","), inner_length(whole)
    links = []
    for x, start, end in parts:
        if x.tag == "a":
            links.append((x, whole[start:end]))
        elif x.tag in HEADINGS:
            out.heading_length += inner_length(whole[start:end])
        else:
            out.list_length += inner_length(whole[start:end])
    out.link_density = link_share(out.length, links)
    return out


def looks_fishy(h: Holdings, weight: int, is_list: bool, in_figure: Callable[[], bool], modifier: float) -> bool:
    """Whether an element with few commas holds the wrong things: images, items, inputs, links, embedded objects."""
    heading_density = h.heading_length / h.length if h.length else 0.0
    return (
        h.images > 1 and h.paragraphs / h.images < 0.5 and not in_figure()
        or not is_list and h.items - 100 > h.paragraphs
        or h.inputs > h.paragraphs // 3
        or not is_list and heading_density < 0.9 and h.length < 25 and (h.images == 0 or h.images > 2) and not in_figure()
        or not is_list and weight < 25 and h.link_density > 0.2 + modifier
        or weight >= 25 and h.link_density > 0.5 + modifier
        or h.embeds == 1 and h.length < 75
        or h.embeds > 1
    )


def clean_conditionally(article: Node, tag: str, rules: Rules) -> None:
    if not rules.conditional:
        return

    def goes(n: Node) -> bool:
        is_data = lambda t: t in rules.data_tables
        if tag == "table" and is_data(n) or under(n, "table", only=is_data) or under(n, "code", 4):
            return False
        weight = rules.weight(n)
        if weight < 0:
            return True
        h = holdings(n, rules.video)
        if h.commas >= 10 or h.video:
            return False
        is_list = tag in ("ul", "ol") or h.length > 0 and h.list_length / h.length > 0.9
        fishy = looks_fishy(h, weight, is_list, lambda: under(n, "figure", 4), rules.density_modifier)
        if fishy and is_list and not any(len(elements(c)) > 1 for c in elements(n)):
            return h.images != h.items  # a list with an image in each item stays
        return fishy

    remove_each(below(article, tag), goes)


def clean_shares(article: Node) -> None:
    """Short elements that offer to share, below each of the article's elements."""
    for top in elements(article):
        end, n = following(top, True), following(top)
        while n is not None and n is not end:
            named = matchers.share(get(n, "class")) or matchers.share(get(n, "id"))
            n = remove_and_follow(n) if named and utf16(text(n)) < SHARE_LENGTH else following(n)


def single_cells(article: Node) -> None:
    """A table of one cell becomes a paragraph or a division."""
    for table in below(article, "table"):
        body = only_element(table) if holds_only(table, "tbody") else table
        if holds_only(body, "tr") and holds_only(row := only_element(body), "td"):
            cell = only_element(row)
            retag(cell, "p" if all(map(is_phrasing, cell.children)) else "div")
            if table.parent is not None:
                table.replace_with(cell)


def clean_article(article: Node, rules: Rules) -> None:
    """All cleaning, in its order: later rules judge what earlier ones left."""
    clean_styles(article)
    rules.data_tables |= {t for t in below(article, "table") if is_data_table(t)}
    lazy_images(article)
    for tag in ("form", "fieldset"):
        clean_conditionally(article, tag, rules)
    for tag in ("object", "embed", "footer", "link", "aside"):
        clean(article, tag, rules.video)
    clean_shares(article)
    for tag in ("iframe", "input", "textarea", "select", "button"):
        clean(article, tag, rules.video)
    remove_each(below(article, "h1", "h2"), lambda n: rules.weight(n) < 0)
    for tag in ("table", "ul", "div"):
        clean_conditionally(article, tag, rules)
    for n in below(article, "h1"):
        retag(n, "h2")
    remove_each(below(article, "p"), lambda n: not below(n, "img", "embed", "object", "iframe") and not trim(text(n)))
    for br in below(article, "br"):
        after = past_blank(next_sibling(br))
        if after is not None and after.tag == "p":
            br.detach()
    single_cells(article)
