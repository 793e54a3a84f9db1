"""What is done to a page's tree before it is scored, and to an article's links, nesting and classes after it."""

from __future__ import annotations

import re

from pagelift.functions import matchers, urls
from pagelift.functions.text import trim
from pagelift.sources.html import ELEMENT, TEXT, Node, parse_fragment

from .dom import below, drop, element, elements, first, following, get, has, holds_only, is_blank, is_hollow, is_phrasing, is_single_image, next_sibling, only_element, past_blank, previous_element, put, remove_and_follow, remove_each, retag, text

# Elements of mathematical markup, and attributes that name images.
MATH = frozenset("math mi mo mn mfrac mover mrow mspace msqrt msub msubsup msup mtable mtd mtext mtr munderover mjx-assistive-mml".split())
IMAGE_ATTRIBUTES = ("src", "srcset", "data-src", "data-srcset")
_IMAGE = re.compile(matchers.IMAGE)
_SRCSET = re.compile(r"([^ \t\n\r\f]+)([ \t\n\r\f]+[0-9.]+[xw])?([ \t\n\r\f]*(?:,|\Z))")


def plain_math(doc: Node) -> None:
    """The assistive form of formulas takes their place, as spans."""
    for box in below(doc, "mjx-container"):
        spoken = first(box, "mjx-assistive-mml")
        if spoken is not None and box.parent is not None:
            span = element("span")
            for c in list(spoken.children):
                span.append(c)
            box.replace_with(span)
    for n in doc.walk():
        if n.kind == ELEMENT and n.tag in MATH:
            retag(n, "span")


def unwrap_noscript_images(doc: Node) -> None:
    """Placeholders without any image go; an image before a noscript with one image gives way to that."""
    for img in below(doc, "img"):
        if not any(k in IMAGE_ATTRIBUTES or _IMAGE.search(v) for k, v in img.attrs):
            img.detach()
    for box in below(doc, "noscript"):
        inside = element("div")
        for n in parse_fragment(text(box)):
            inside.append(n)
        if not is_single_image(inside):
            continue
        before = previous_element(box)
        if before is None or not is_single_image(before):
            continue
        old = before if before.tag == "img" else below(before, "img")[0]
        new = below(inside, "img")[0]
        for key, value in old.attrs:
            if value and (key in ("src", "srcset") or _IMAGE.search(value)) and get(new, key) != value:
                put(new, f"data-old-{key}" if has(new, key) else key, value)
        before.replace_with(elements(inside)[0])


def breaks_to_paragraphs(body: Node) -> None:
    """Two or more breaks in a row make a paragraph of what follows them, up to the next such row or block."""
    for br in below(body, "br"):
        if br.parent is None:
            continue
        after, found = past_blank(next_sibling(br)), False
        while after is not None and after.tag == "br":
            found = True
            beyond = next_sibling(after)
            after.detach()
            after = beyond
            if after is not None and after.kind != ELEMENT:
                break
        if not found:
            continue
        p = element("p")
        br.replace_with(p)
        after = next_sibling(p)
        while after is not None:
            if after.tag == "br":
                again = past_blank(next_sibling(after))
                if again is not None and again.tag == "br":
                    break
            if not is_phrasing(after):
                break
            beyond = next_sibling(after)
            p.append(after)
            after = beyond
        while p.children and is_blank(p.children[-1]):
            p.children[-1].detach()
        if p.parent.tag == "p":
            retag(p.parent, "div")


def prepare(doc: Node, body: Node | None) -> None:
    remove_each(below(doc, "script", "noscript"))
    remove_each(below(doc, "style"))
    if body is not None:
        breaks_to_paragraphs(body)
    for n in below(doc, "font"):
        retag(n, "span")


def base_uri(doc: Node, page_url: str) -> str:
    """The page's URL, or what its first base element makes of it."""
    own = first(doc, "base")
    href = urls.parse(get(own, "href")) if own is not None and get(own, "href") else None
    page = urls.parse(page_url)
    return str(urls.resolve(page, href)) if href is not None and page is not None else page_url


def absolute_links(article: Node, base: str, page_url: str) -> None:
    """Links and media get absolute URLs; links to scripts become their content."""
    start = urls.parse(base)

    def absolute(uri: str) -> str:
        uri = trim(uri)
        if not uri or base == page_url and uri[0] == "#" or start is None or (ref := urls.parse(uri)) is None:
            return uri
        out = str(urls.resolve(start, ref))
        return out + "#" if uri.endswith("#") and not out.endswith("#") else out

    scripts = []
    for n in article.walk():
        if n.kind != ELEMENT:
            continue
        if n.tag == "a" and (href := get(n, "href")):
            if matchers.javascript(href):
                scripts.append(n)
            else:
                put(n, "href", ",%20".join(map(absolute, href.split(",%20"))))
        elif n.tag in ("img", "picture", "figure", "video", "audio", "source"):
            for key in ("src", "poster"):
                if value := get(n, key):
                    put(n, key, absolute(value))
            if value := get(n, "srcset"):
                found = [absolute(m.group(1)) + (m.group(2) or "") + m.group(3) for m in _SRCSET.finditer(value)]
                put(n, "srcset", (" " if ", " in value else "").join(found))
    for link in scripts:
        if len(link.children) == 1 and link.children[0].kind == TEXT:
            link.replace_with(Node(TEXT, text=link.children[0].text))
        else:
            span = element("span")
            for c in list(link.children):
                span.append(c)
            link.replace_with(span)


def simplify(article: Node, page: Node | None = None) -> None:
    """Empty divisions go, and one that holds nothing but another becomes that one, with the attributes of both; the
    page's own division stays."""
    n = article
    while n is not None:
        if n.parent is not None and n.tag in ("div", "section") and n is not page:
            if is_hollow(n):
                n = remove_and_follow(n)
                continue
            if holds_only(n, "div") or holds_only(n, "section"):
                child = only_element(n)
                for key, value in n.attrs:
                    put(child, key, value)
                n.replace_with(child)
                n = child
                continue
        n = following(n)


def kept_classes(value: str, kept: tuple[str, ...]) -> str:
    return " ".join(c for c in re.split("[ \t\n\r\f]+", value) if c and c in kept)


def clean_classes(article: Node, kept: tuple[str, ...]) -> None:
    for n in article.walk():
        if n.kind == ELEMENT:
            own = kept_classes(get(n, "class"), kept)
            if own:
                put(n, "class", own)
            else:
                drop(n, "class")
