"""Reading and changing a page's tree: attributes, neighbours, texts, visibility."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pagelift.functions.text import WIDE, inner, inner_length, trim, utf16
from pagelift.sources.html import ELEMENT, TEXT, Node


def _same(key: str, name: str) -> bool:
    return key == name or not key.isascii() and key.lower().replace("ſ", "s") == name or key.lower() == name


def get(n: Node, name: str) -> str:
    """The value of the first attribute of that name, '' if there is none."""
    for k, v in n.attrs:
        if k == name or _same(k, name):
            return v
    return ""


def has(n: Node, name: str) -> bool:
    return any(k == name or _same(k, name) for k, _ in n.attrs)


def put(n: Node, name: str, value: str) -> None:
    for a in n.attrs:
        if _same(a[0], name):
            a[1] = value
            return
    n.attrs.append([name, value])


def drop(n: Node, name: str) -> None:
    for i, (k, _) in enumerate(n.attrs):
        if _same(k, name):
            del n.attrs[i]
            return


def element(tag: str, **attrs: str) -> Node:
    return Node(ELEMENT, tag, attrs=[[k.rstrip("_"), v] for k, v in attrs.items()])


def retag(n: Node, tag: str) -> Node:
    n.tag, n.space = tag, ""
    return n


def text(n: Node) -> str:
    """All text below a node; comments have none."""
    if n.kind == TEXT:
        return n.text
    if n.kind != ELEMENT and not n.children:
        return ""
    return "".join([x.text for x in n.walk() if x.kind == TEXT])


def inner_text(n: Node) -> str:
    return inner(text(n))


def text_length(n: Node) -> int:
    return inner_length(text(n))


def below(n: Node, *tags: str) -> list[Node]:
    """Elements below a node, grouped by the order of tags, then in document order; without tags, all."""
    if not tags:
        return [x for x in n.walk() if x.kind == ELEMENT and x is not n]
    if len(tags) == 1:
        return [x for x in n.walk() if x.tag == tags[0] and x is not n and x.kind == ELEMENT]
    found: dict[str, list[Node]] = {t: [] for t in tags}
    for x in n.walk():
        if x.kind == ELEMENT and x is not n and x.tag in found:
            found[x.tag].append(x)
    return [x for t in tags for x in found[t]]


def first(n: Node, tag: str) -> Node | None:
    """The first element of that tag, the node itself counted."""
    return next((x for x in n.walk() if x.tag == tag and x.kind == ELEMENT), None)


def elements(n: Node) -> list[Node]:
    return [c for c in n.children if c.kind == ELEMENT]


def only_element(n: Node) -> Node | None:
    found = None
    for c in n.children:
        if c.kind == ELEMENT:
            if found is not None:
                return None
            found = c
    return found


def _beside(n: Node, step: int) -> Node | None:
    if n.parent is None:
        return None
    row = n.parent.children
    i = n.place() + step
    while 0 <= i < len(row):
        if row[i].kind == ELEMENT:
            row[i].at = i
            return row[i]
        i += step
    return None


def next_element(n: Node) -> Node | None:
    return _beside(n, 1)


def previous_element(n: Node) -> Node | None:
    return _beside(n, -1)


def following(n: Node, over: bool = False) -> Node | None:
    """The next element in document order; over: without those below the node."""
    if not over:
        for c in n.children:
            if c.kind == ELEMENT:
                return c
    while n is not None:
        beside = _beside(n, 1)
        if beside is not None:
            return beside
        n = n.parent
    return None


def remove_and_follow(n: Node) -> Node | None:
    after = following(n, True)
    n.detach()
    return after


def ancestors(n: Node) -> list[Node]:
    out = []
    while n.parent is not None:
        n = n.parent
        out.append(n)
    return out


def under(n: Node, tag: str, levels: int | None = None, only: Callable[[Node], bool] | None = None) -> bool:
    """Whether an ancestor, among the nearest levels, has that tag (and meets a condition)."""
    up = ancestors(n)
    return any(a.tag == tag and a.kind == ELEMENT and (only is None or only(a)) for a in (up if levels is None else up[:levels]))


def remove_each(nodes: Iterable[Node], when: Callable[[Node], bool] | None = None) -> None:
    """Remove nodes from last to first; the condition sees what the removals before it left."""
    for n in reversed(list(nodes)):
        if n.parent is not None and (when is None or when(n)):
            n.detach()


def past_blank(n: Node | None) -> Node | None:
    """The node itself or the next sibling that is an element or has text."""
    if n is None or n.parent is None:
        return n
    row = n.parent.children
    for x in row[row.index(n) :]:
        if x.kind == ELEMENT or text(x).strip(" \t\n\r\f"):
            return x
    return None


def next_sibling(n: Node) -> Node | None:
    if n.parent is None:
        return None
    row = n.parent.children
    i = row.index(n) + 1
    return row[i] if i < len(row) else None


def is_blank(n: Node) -> bool:
    return n.kind == TEXT and not trim(n.text) or n.kind == ELEMENT and n.tag == "br"


def has_text(n: Node) -> bool:
    return any(x.kind == TEXT and trim(x.text) for x in n.walk())


# Element names by what their text means.
PHRASING = frozenset(
    "abbr audio b bdo br button cite code data datalist dfn em embed i img input kbd label mark math meter noscript "
    "object output progress q ruby samp script select small span strong sub sup textarea time var wbr".split()
)
BLOCK_INSIDE = frozenset("blockquote dl div img ol p pre table ul".split())


def is_phrasing(n: Node) -> bool:
    todo = [n]
    while todo:
        x = todo.pop()
        if x.kind == TEXT or x.kind == ELEMENT and x.tag in PHRASING:
            continue
        if x.kind != ELEMENT or x.tag not in ("a", "del", "ins"):
            return False
        todo.extend(x.children)
    return True


def has_block_inside(n: Node) -> bool:
    return any(x.tag in BLOCK_INSIDE for x in n.walk() if x is not n)


def holds_only(n: Node, tag: str) -> bool:
    """One element, of that tag, and no text of its own that ends in more than a space."""
    child = only_element(n)
    return child is not None and child.tag == tag and not any(c.kind == TEXT and c.text and c.text[-1] not in " \t\n\r\f" for c in n.children)


def is_hollow(n: Node) -> bool:
    """An element without text whose elements are none, or as many as the breaks and rules below it."""
    if n.kind != ELEMENT or has_text(n):
        return False
    direct = len(elements(n))
    return direct == 0 or direct == len(below(n, "br", "hr"))


def is_single_image(n: Node) -> bool:
    while n.tag != "img":
        child = only_element(n)
        if child is None or trim(text(n)):
            return False
        n = child
    return True


def style(n: Node, name: str) -> str:
    """An inline style's value: the last declaration, unless an important one stands against it."""
    if name == "backgroundImage":
        name = "background-image"
    value, important = "", False
    for part in get(n, "style").split(";"):
        key, colon, given = part.partition(":")
        if not colon or trim(key).lower().replace("ſ", "s") != name:
            continue
        given, weighty = trim(given), False
        body, mark, tail = given.rpartition("!")
        if mark and "".join(c for c in tail if c not in WIDE).lower() == "important" and tail.isascii():
            given, weighty = trim(body), True
        if weighty or not important:
            value, important = given, weighty
    return value


def is_visible(n: Node) -> bool:
    if n.kind == ELEMENT and n.attrs:
        if style(n, "display").lower() == "none" or style(n, "visibility").lower() == "hidden" or has(n, "hidden"):
            return False
        return get(n, "aria-hidden").lower() != "true" or "fallback-image" in get(n, "class")
    return True


def link_share(length: int, links: Iterable[tuple[Node, str]]) -> float:
    """Share of a text of that length that stands in links; links within the page count less."""
    if not length:
        return 0.0
    return sum(inner_length(t) * (0.3 if len(h := get(a, "href")) > 1 and h[0] == "#" else 1.0) for a, t in links) / length


def link_density(n: Node) -> float:
    return link_share(text_length(n), ((a, text(a)) for a in below(n, "a")))


def trimmed_length(n: Node) -> int:
    return utf16(trim(text(n)))
