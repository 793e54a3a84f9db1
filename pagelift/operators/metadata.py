"""Title, author, description, site and time of a page, from JSON-LD, meta elements and the title heuristic."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, fields
from typing import Any

from pagelift.functions import matchers
from pagelift.functions.text import collapse, similarity, trim, utf16
from pagelift.functions.urls import parse
from pagelift.sources.html import Node

from .dom import below, get, inner_text, text

# The characters and patterns that titles, meta names and JSON-LD are read by.
_SIGNS = r"\|\-–—\\/>»"
_PADDED = re.compile(f" [{_SIGNS}] ")
_HIERARCHICAL = re.compile(r" [\\/>»] ")
_BEFORE_LAST = re.compile(f"([^\n]*)[{_SIGNS}] [^\n]*")
_THROUGH_FIRST = re.compile(f"^[^{_SIGNS}]*[{_SIGNS}]")
_SIGN_RUNS = re.compile(f"[{_SIGNS}]+")
_SPACES = re.compile("[ \t\n\r\f]+")
_SPACE = "[ \t\n\r\f]"
_PROPERTY = re.compile(f"{_SPACE}*(article|dc|dcterm|og|twitter){_SPACE}*:{_SPACE}*(author|creator|description|published_time|title|site_name){_SPACE}*", re.IGNORECASE | re.ASCII)
_NAME = re.compile(f"^{_SPACE}*(?:(dc|dcterm|og|twitter|parsely|weibo:(article|webpage)){_SPACE}*[-.:]?{_SPACE}*)?(author|creator|pub-date|description|title|site_name){_SPACE}*\\Z", re.IGNORECASE | re.ASCII)
_CDATA = re.compile(f"^{_SPACE}*<!\\[CDATA\\[|\\]\\]>{_SPACE}*\\Z")
_SCHEMA = re.compile(matchers.SCHEMA)

TITLE_KEYS = ["dc:title", "dcterm:title", "og:title", "weibo:article:title", "weibo:webpage:title", "title", "twitter:title", "parsely-title"]
BYLINE_KEYS = ["dc:creator", "dcterm:creator", "author", "parsely-author"]
EXCERPT_KEYS = ["dc:description", "dcterm:description", "og:description", "weibo:article:description", "weibo:webpage:description", "description", "twitter:description"]
SITE_KEYS = ["og:site_name"]
TIME_KEYS = ["article:published_time", "parsely-pub-date"]


@dataclass
class Metadata:
    title: str = ""
    byline: str = ""
    excerpt: str = ""
    site_name: str = ""
    published_time: str = ""


def _count(words: str) -> int:
    return len(_SPACES.split(words))


def heuristic_title(title: str | None, h1: list[str], h2: list[str], h1_inner: list[str]) -> str:
    """The title by its separators, colons and length. title: inner text of the title element (None: there is none);
    h1, h2: trimmed texts of headings; h1_inner: inner texts of the first level's."""
    if title is None:
        title = ""
    now, hierarchical = title, False
    if _PADDED.search(title):
        hierarchical = _HIERARCHICAL.search(title) is not None
        m = _BEFORE_LAST.search(title)
        if m:
            now = m.group(1)
        if _count(now) < 3:
            now = _THROUGH_FIRST.sub("", title)
    elif ": " in title:
        before, _, after = title.partition(":")
        if trim(title) not in h1 + h2:
            now = title.rpartition(":")[2]
        if _count(now) < 3:
            now = after
        elif _count(before) > 5:
            now = title
    elif not 15 <= utf16(title) <= 150 and len(h1) == 1:
        now = h1_inner[0]
    now = collapse(trim(now))
    words = _count(now)
    if words <= 4 and (not hierarchical or words != _count(_SIGN_RUNS.sub("", title))):
        now = title
    return now


def page_title(doc: Node) -> str:
    titles, h1, h2 = below(doc, "title"), below(doc, "h1"), below(doc, "h2")
    return heuristic_title(inner_text(titles[0]) if titles else None, [trim(text(h)) for h in h1], [trim(text(h)) for h in h2], [inner_text(h) for h in h1])


def loads(source: str) -> Any:
    """Strict JSON; what is none raises ValueError. Halves of surrogate pairs are replaced."""

    def never(name: str) -> None:
        raise ValueError(name)

    return _whole(json.loads(source, parse_constant=never))


def _whole(value: Any) -> Any:
    """The value with U+FFFD for each half of a surrogate pair."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, list):
        return [_whole(x) for x in value]
    return {_whole(k): _whole(v) for k, v in value.items()} if isinstance(value, dict) else value


def vocabulary(context: Any, before: str = "") -> str:
    """The vocabulary that a JSON-LD context leaves; later entries go over earlier ones."""
    if isinstance(context, str):
        return context if _SCHEMA.search(context) else before
    if isinstance(context, dict):
        if "@vocab" not in context:
            return before
        return context["@vocab"] if isinstance(context["@vocab"], str) else ""
    if isinstance(context, list):
        for item in context:
            before = vocabulary(item, before)
    return before


def _string(value: Any, key: str) -> str:
    own = value.get(key) if isinstance(value, dict) else None
    return trim(own) if isinstance(own, str) else ""


def from_object(value: dict, title) -> Metadata:
    """Fields of a JSON-LD article; title gives the heuristic title when name and headline differ."""
    name, headline = (x if isinstance(x := value.get(k), str) else "" for k in ("name", "headline"))
    chosen = name or headline
    if name and headline and name != headline:
        own = title()
        if similarity(headline, own) > 0.75 and similarity(name, own) <= 0.75:
            chosen = headline
    author = value.get("author")
    byline = trim(author) if isinstance(author, str) else _string(author, "name")
    if isinstance(author, list):
        byline = ", ".join(n for a in author if (n := _string(a, "name")))
    return Metadata(trim(chosen), byline, _string(value, "description"), _string(value.get("publisher"), "name"), _string(value, "datePublished"))


def json_ld(sources: list[str], title) -> Metadata | None:
    """The first article of the JSON-LD scripts' contents, of a page's objects or those of their graphs."""
    for source in sources:
        try:
            value = loads(_CDATA.sub("", source))
        except (ValueError, RecursionError):
            continue
        for root in value if isinstance(value, list) else [value]:
            if not isinstance(root, dict) or not _SCHEMA.search(vocabulary(root.get("@context"))):
                continue
            graph = root.get("@graph")
            for own in [root, *(graph if isinstance(graph, list) else [])]:
                if isinstance(own, dict) and matchers.article_type(own.get("@type")):
                    return from_object(own, title)
    return None


def meta_values(metas: list[tuple[str, str, str]]) -> dict[str, str]:
    """Values by key, of (name, property, content); later ones go over earlier ones."""
    out: dict[str, str] = {}
    for name, prop, content in metas:
        if not content:
            continue
        m = _PROPERTY.search(prop)
        if m:
            out[re.sub(_SPACE, "", m.group().lower())] = trim(content)
        elif name and _NAME.search(name):
            out[re.sub(_SPACE, "", name.lower()).replace(".", ":")] = trim(content)
    return out


def _any(values: dict[str, str], keys: list[str], before: str = "") -> str:
    return before or next((values[k] for k in keys if values.get(k)), "")


def combine(values: dict[str, str], found: Metadata | None, title) -> Metadata:
    """JSON-LD first, then meta values in their order, then the heuristic title."""
    found = found or Metadata()
    author = values.get("article:author", "")
    url = parse(author)
    out = Metadata(
        _any(values, TITLE_KEYS, found.title) or title(),
        _any(values, BYLINE_KEYS, found.byline) or ("" if url is not None and url.scheme else author),
        _any(values, EXCERPT_KEYS, found.excerpt),
        _any(values, SITE_KEYS, found.site_name),
        _any(values, TIME_KEYS, found.published_time),
    )
    for f in fields(out):
        setattr(out, f.name, html.unescape(getattr(out, f.name)))
    return out


def scripts(doc: Node) -> list[str]:
    return [text(s) for s in below(doc, "script") if get(s, "type") == "application/ld+json"]


def page_metadata(doc: Node, found: Metadata | None) -> Metadata:
    metas = [(get(m, "name"), get(m, "property"), get(m, "content")) for m in below(doc, "meta")]
    return combine(meta_values(metas), found, lambda: page_title(doc))
