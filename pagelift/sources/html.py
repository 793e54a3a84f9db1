"""HTML source and sink: a tree builder after the HTML standard, and a serializer.

Scripting counts as on, so noscript is raw text. The tree is plain Python objects; nothing recurses, so the depth of a
page is bounded by memory alone.
"""

from __future__ import annotations

import html as _entities
import re
from collections.abc import Iterator

DOCUMENT, ELEMENT, TEXT, COMMENT, DOCTYPE = range(5)


class Node:
    """A node of a page's tree. tag is lower-case; attrs is a list of [key, value]; text is of text and comments."""

    __slots__ = ("kind", "tag", "text", "attrs", "parent", "children", "space", "at")

    def __init__(self, kind: int, tag: str = "", text: str = "", attrs: list[list[str]] | None = None, space: str = ""):
        self.kind, self.tag, self.text, self.attrs, self.space = kind, tag, text, attrs if attrs is not None else [], space
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.at = 0

    def place(self) -> int:
        """The node's place among its parent's children: near the one it was last known to have, else searched for."""
        row, i = self.parent.children, self.at
        if i >= len(row) or row[i] is not self:
            for i in range(min(i, len(row) - 1), max(-1, i - 9), -1):
                if row[i] is self:
                    break
            else:
                i = row.index(self)
            self.at = i
        return i

    def append(self, child: Node) -> None:
        child.detach()
        child.parent, child.at = self, len(self.children)
        self.children.append(child)

    def insert_before(self, child: Node, place: Node) -> None:
        child.detach()
        child.parent, child.at = self, place.place()
        self.children.insert(child.at, child)

    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.place()]
            self.parent = None

    def replace_with(self, other: Node) -> None:
        parent = self.parent
        other.detach()
        other.at = self.place()
        parent.children[other.at] = other
        self.parent, other.parent = None, parent

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order. The tree must not change meanwhile."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if n.children:
                todo.extend(reversed(n.children))

    def clone(self) -> Node:
        top = Node(self.kind, self.tag, self.text, [list(a) for a in self.attrs], self.space)
        todo = [(self, top)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                own = Node(c.kind, c.tag, c.text, [list(a) for a in c.attrs], c.space)
                own.parent, own.at = new, len(new.children)
                new.children.append(own)
                if c.children:
                    todo.append((c, own))
        return top


# Element names by their role in parsing and serializing.
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style xmp".split())
ESCAPABLE_RAW = frozenset(("textarea", "title"))
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup "
    "main menu nav ol p search section summary ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd "
    "details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object "
    "ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot "
    "th thead title tr track ul wbr xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
TABLE_PARTS = frozenset(("tbody", "tfoot", "thead"))
SPACES = " \t\n\r\f"

_TAG = re.compile(r"</?[a-zA-Z]")
_NAME = re.compile(r"[^\t\n\f\r />\0]+")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_SEMICOLONLESS = re.compile(r"&([a-zA-Z0-9]+)(?![a-zA-Z0-9;])=|&([a-zA-Z][a-zA-Z0-9]*);?")
_CHARSET = {ord("\0"): "�"}


def decode_text(text: str) -> str:
    return _entities.unescape(text) if "&" in text else text


def decode_attribute(text: str) -> str:
    """Character references of an attribute: one without a semicolon stays before = or a letter or digit."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        name = m.group(1)
        if name[0] != "#" and not name.endswith(";"):
            after = text[m.end() : m.end() + 1]
            if after == "=" or after.isalnum() and after.isascii():
                return m.group()
            whole = "&" + name
            found = _entities.unescape(whole)
            # A known name with more letters behind it, as in &notit, stays, too.
            return found if found != whole and not found[-1:].isalnum() else whole
        return _entities.unescape(m.group())

    return re.sub(r"&(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z][a-zA-Z0-9]*;?)", one, text)


def tokens(page: str) -> Iterator[tuple]:
    """("text", data), ("start", name, attrs, self-closing), ("end", name), ("comment", data), ("doctype", data)."""
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    at, size, find = 0, len(page), page.find
    low = None
    while at < size:
        open_ = find("<", at)
        if open_ < 0:
            yield "text", decode_text(page[at:])
            return
        after = page[open_ + 1 : open_ + 2]
        is_tag = after.isascii() and after.isalpha()
        if not is_tag and after not in ("!", "?", "/") or after == "/" and open_ + 2 >= size:
            # A sign that opens no tag is text up to the next one.
            close = find("<", open_ + 1)
            close = size if close < 0 else close
            yield "text", decode_text(page[at:close])
            at = close
            continue
        if open_ > at:
            yield "text", decode_text(page[at:open_])
        if page.startswith("<!--", open_):
            if page.startswith(("<!-->", "<!--->"), open_):
                at = find(">", open_) + 1
                yield "comment", ""
                continue
            ends = [(e, n) for e, n in ((find("-->", open_ + 4), 3), (find("--!>", open_ + 4), 4)) if e >= 0]
            end, n = min(ends, default=(size, 0))
            yield "comment", page[open_ + 4 : end]
            at = end + n
            continue
        if after in ("!", "?") or after == "/" and not _TAG.match(page, open_):
            end = find(">", open_ + 2)
            end = size if end < 0 else end
            body = page[open_ + 2 : end]
            if after == "!" and body[:7].lower() == "doctype":
                yield "doctype", body[7:].strip()
            elif after == "!" and body.startswith("[CDATA["):
                close = find("]]>", open_)
                yield "cdata", page[open_ + 9 : close if close >= 0 else size], body
                end = end if close < 0 else end
            elif after == "?":
                yield "comment", "?" + body
            elif not (after == "/" and end == open_ + 2):
                yield "comment", body
            at = end + 1
            continue
        closing = after == "/"
        m = _NAME.match(page, open_ + 1 + closing)
        name, at = m.group().lower(), m.end()
        attrs: list[list[str]] = []
        seen = set()
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:
                break
            quoted = next((g for g in (m.group(2), m.group(3), m.group(4)) if g is not None), "")
            key = m.group(1).lower()
            if key not in seen:
                seen.add(key)
                attrs.append([key, decode_attribute(quoted)])
            if m.end() == at:
                break
            at = m.end()
        end = find(">", at)
        if end < 0:
            return  # a tag that the page's end cuts is dropped
        selfclosing = page[end - 1] == "/" and "/" in page[at:end]
        at = end + 1
        if closing:
            yield "end", name
            continue
        raw = yield "start", name, attrs, selfclosing
        if raw:
            if raw == "plaintext":
                yield "text", page[at:]
                return
            if low is None:
                low = page.lower() if len(page.lower()) == size else page
            close = at
            while True:
                close = low.find("</" + name, close)
                if close < 0 or low[close + 2 + len(name) : close + 3 + len(name)] in ("", *SPACES, "/", ">"):
                    break
                close += 2
            body = page[at : close if close >= 0 else size]
            if body:
                yield "text", decode_text(body) if name in ESCAPABLE_RAW else body
            if close < 0:
                return
            at = find(">", close)
            yield "end", name
            if at < 0:
                return
            at += 1


class TreeBuilder:
    """Insertion modes of the HTML standard, as methods by name; each returns True to have the token read again."""

    def __init__(self, context: str = ""):
        self.root = Node(DOCUMENT)
        self.stack: list[Node] = []
        self.active: list[Node | None] = []  # formatting elements; None is a marker
        self.head: Node | None = None
        self.form: Node | None = None
        self.mode, self.back = self.initial, None
        self.frames_ok, self.foster = True, False
        self.templates: list = []
        self.skip_newline = False
        if context:
            top = Node(ELEMENT, "html")
            self.root.append(top)
            self.stack = [top]
            self.mode = self.in_body

    # -- tree operations

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def place(self, node: Node) -> None:
        """Insert a node where the next one goes: into the open element, or before its table."""
        if self.foster and self.top.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.stack) - 1, -1, -1):
                own = self.stack[i]
                if own.tag == "template" and not own.space:
                    own.append(node)
                    return
                if own.tag == "table" and not own.space:
                    if own.parent is not None:
                        here = own.parent.children.index(own)
                        before = own.parent.children[here - 1] if here else None
                        if node.kind == TEXT and before is not None and before.kind == TEXT:
                            before.text += node.text
                        else:
                            own.parent.insert_before(node, own)
                    else:
                        self.stack[i - 1].append(node)
                    return
            self.stack[0].append(node)
            return
        last = self.top.children[-1] if self.top.children else None
        if node.kind == TEXT and last is not None and last.kind == TEXT:
            last.text += node.text
        else:
            self.top.append(node)

    def open(self, tag: str, attrs: list[list[str]] | None = None, space: str = "") -> Node:
        node = Node(ELEMENT, tag, attrs=attrs, space=space)
        self.place(node)
        self.stack.append(node)
        return node

    def put(self, token: tuple) -> Node:
        return self.open(token[1], token[2])

    def text(self, data: str) -> None:
        if data:
            self.place(Node(TEXT, text=data))

    def scope(self, tags, extra: frozenset = frozenset(), only: frozenset | None = None) -> bool:
        """Whether one of the tags is open above the next element that ends the scope."""
        for n in reversed(self.stack):
            if n.tag in tags and not n.space:
                return True
            if only is not None:
                if n.tag in only:
                    return False
            elif n.space and n.tag in ("mi", "mo", "mn", "ms", "mtext", "annotation-xml", "foreignobject", "foreignObject", "desc", "title"):
                return False
            elif not n.space and (n.tag in SCOPE or n.tag in extra):
                return False
        return False

    def pop_to(self, *tags: str) -> None:
        while self.stack and len(self.stack) > 1:
            if (n := self.stack.pop()).tag in tags and not n.space:
                return

    def clear_to(self, *tags: str) -> None:
        while len(self.stack) > 1 and self.top.tag not in tags:
            self.stack.pop()

    def imply(self, but: str = "") -> None:
        while self.top.tag in IMPLIED and self.top.tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.scope(("p",), frozenset(("button",))):
            self.imply("p")
            self.pop_to("p")

    # -- formatting elements

    def remember(self, node: Node) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            own = self.active[i]
            if own is None:
                break
            if own.tag == node.tag and own.space == node.space and sorted(own.attrs) == sorted(node.attrs):
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(node)

    def to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self.open(self.active[k].tag, [list(a) for a in self.active[k].attrs])

    def adopt(self, tag: str) -> None:
        """The adoption agency: end tags of formatting elements that are not closed in order."""
        if self.top.tag == tag and self.top not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            element = None
            for own in reversed(self.active):
                if own is None:
                    break
                if own.tag == tag:
                    element = own
                    break
            if element is None:
                self.any_end(tag)
                return
            if element not in self.stack:
                self.active.remove(element)
                return
            if not self.scope((tag,)):
                return
            at = self.stack.index(element)
            block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL and not n.space), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(element)
                return
            ancestor = self.stack[at - 1]
            mark = self.active.index(element)
            last, i = block, self.stack.index(block)
            for inner in range(1, 10_000):
                i -= 1
                node = self.stack[i]
                if node is element:
                    break
                if inner > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    del self.stack[i]
                    continue
                copy = Node(ELEMENT, node.tag, attrs=[list(a) for a in node.attrs])
                self.active[self.active.index(node)] = copy
                self.stack[i] = copy
                if last is block:
                    mark = self.active.index(copy) + 1
                copy.append(last)
                last = copy
            last.detach()
            if ancestor.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                held, self.stack, foster = self.stack, self.stack[: self.stack.index(ancestor) + 1], self.foster
                self.foster = True
                self.place(last)
                self.stack, self.foster = held, foster
            else:
                ancestor.append(last)
            copy = Node(ELEMENT, element.tag, attrs=[list(a) for a in element.attrs])
            for child in list(block.children):
                copy.append(child)
            block.append(copy)
            old = self.active.index(element)
            del self.active[old]
            self.active.insert(mark - (old < mark), copy)
            self.stack.remove(element)
            self.stack.insert(self.stack.index(block) + 1, copy)

    def any_end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            n = self.stack[i]
            if n.tag == tag and not n.space:
                self.imply(tag)
                del self.stack[i:]
                return
            if n.tag in SPECIAL and not n.space:
                return

    # -- driving

    def feed(self, page: str) -> Node:
        source = tokens(page)
        answer = None
        while True:
            try:
                token = source.send(answer)
            except StopIteration:
                break
            answer = None
            kind = token[0]
            if self.skip_newline:
                self.skip_newline = False
                if kind == "text" and token[1][:1] == "\n":
                    token = ("text", token[1][1:])
                    if not token[1]:
                        continue
            if kind == "cdata":
                token = ("text", token[1]) if self.stack and self.top.space else ("comment", token[2])
                kind = token[0]
            if kind == "comment":
                self.comment(token[1])
                continue
            foreign = self.stack and self.top.space and not self.integration(token)
            again = True
            while again:
                again = self.in_foreign(token) if foreign else self.mode(token)
                foreign = False
            if kind == "start":
                name = token[1]
                own = self.stack and self.top.tag == name and not self.top.space
                if own and (name in RAW or name in ESCAPABLE_RAW) or own and name == "plaintext":
                    answer = name
        if self.mode == self.in_text:
            self.mode(("eof",))
        while self.templates and any(n.tag == "template" for n in self.stack):
            self.end_template()
        for _ in range(12):  # the end of the page passes the modes that only await more
            before = self.mode
            if self.mode in (self.initial, self.before_html, self.before_head, self.in_head, self.after_head):
                self.mode(("eof",))
            if self.mode == before:
                break
        return self.root

    def comment(self, data: str) -> None:
        node = Node(COMMENT, text=data)
        if self.mode in (self.initial, self.before_html, self.after_after_body) or not self.stack:
            self.root.append(node)
        elif self.mode == self.after_body:
            self.stack[0].append(node)
        else:
            self.place(node)

    def reset(self) -> None:
        modes = {"select": self.in_select, "td": self.in_cell, "th": self.in_cell, "tr": self.in_row, "tbody": self.in_table_body, "thead": self.in_table_body, "tfoot": self.in_table_body, "caption": self.in_caption, "colgroup": self.in_columns, "table": self.in_table, "body": self.in_body, "head": self.in_head, "frameset": self.in_frameset}
        for n in reversed(self.stack):
            if n.space:
                continue
            if n.tag == "template" and self.templates:
                self.mode = self.templates[-1]
                return
            if n.tag in modes:
                self.mode = modes[n.tag]
                return
            if n.tag == "html":
                self.mode = self.in_body if any(c.tag == "body" for c in n.children) or self.head is None and not self.root.children else self.after_head if self.head is not None else self.before_head
                return
        self.mode = self.in_body

    # -- modes before the body

    @staticmethod
    def split_space(data: str) -> tuple[str, str]:
        rest = data.lstrip(SPACES)
        return data[: len(data) - len(rest)], rest

    def initial(self, token: tuple) -> bool:
        if token[0] == "doctype":
            self.root.append(Node(DOCTYPE, text=token[1]))
            self.mode = self.before_html
            return False
        if token[0] == "text" and not token[1].strip(SPACES):
            return False
        self.mode = self.before_html
        return True

    def before_html(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "doctype" or kind == "text" and not token[1].strip(SPACES):
            return False
        if kind == "end" and token[1] not in ("head", "body", "html", "br"):
            return False
        node = Node(ELEMENT, "html", attrs=token[2] if kind == "start" and token[1] == "html" else [])
        self.root.append(node)
        self.stack.append(node)
        self.mode = self.before_head
        return not (kind == "start" and token[1] == "html")

    def before_head(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "doctype" or kind == "text" and not token[1].strip(SPACES):
            return False
        if kind == "start" and token[1] == "html":
            return self.in_body(token)
        if kind == "end" and token[1] not in ("head", "body", "html", "br"):
            return False
        own = kind == "start" and token[1] == "head"
        self.head = self.open("head", token[2] if own else [])
        self.mode = self.in_head
        return not own

    def in_head(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text":
            space, rest = self.split_space(token[1])
            self.text(space)
            if not rest:
                return False
            token = ("text", rest)
        elif kind == "doctype":
            return False
        elif kind == "start":
            name = token[1]
            if name == "html":
                return self.in_body(token)
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self.put(token)
                self.stack.pop()
                return False
            if name in RAW or name == "title":
                self.put(token)
                self.mode, self.back = self.in_text, self.mode
                return False
            if name == "template":
                self.put(token)
                self.active.append(None)
                self.templates.append(self.in_template)
                self.mode = self.in_template
                return False
            if name == "head":
                return False
        elif kind == "end":
            if token[1] == "head":
                self.stack.pop()
                self.mode = self.after_head
                return False
            if token[1] == "template":
                self.end_template()
                return False
            if token[1] not in ("body", "html", "br"):
                return False
        self.stack.pop()
        self.mode = self.after_head
        if kind == "text":
            return self.rerun(token)
        return True

    def rerun(self, token: tuple) -> bool:
        while self.mode(token):
            pass
        return False

    def end_template(self) -> None:
        if any(n.tag == "template" for n in self.stack):
            self.pop_to("template")
            self.to_marker()
            if self.templates:
                self.templates.pop()
            self.reset()

    def after_head(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text":
            space, rest = self.split_space(token[1])
            self.text(space)
            if not rest:
                return False
            token = ("text", rest)
        elif kind == "doctype":
            return False
        elif kind == "start":
            name = token[1]
            if name == "html":
                return self.in_body(token)
            if name == "body":
                self.put(token)
                self.frames_ok, self.mode = False, self.in_body
                return False
            if name == "frameset":
                self.put(token)
                self.mode = self.in_frameset
                return False
            if name in HEAD:
                self.stack.append(self.head)
                self.in_head(token)
                if self.head in self.stack:
                    self.stack.remove(self.head)
                if self.mode == self.in_text:
                    self.back = self.after_head
                return False
            if name == "head":
                return False
        elif kind == "end":
            if token[1] == "template":
                return self.in_head(token)
            if token[1] not in ("body", "html", "br"):
                return False
        self.open("body")
        self.mode = self.in_body
        if kind == "text":
            return self.rerun(token)
        return True

    def in_text(self, token: tuple) -> bool:
        if token[0] == "text":
            self.text(token[1])
            return False
        if token[0] == "end":
            self.stack.pop()
            self.mode = self.back
            return False
        self.stack.pop()
        self.mode = self.back
        return True

    # -- the body

    def in_body(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text":
            data = token[1].replace("\0", "")
            if not data:
                return False
            self.reconstruct()
            self.text(data)
            if self.frames_ok and data.strip(SPACES):
                self.frames_ok = False
            return False
        if kind == "start":
            return self.start_in_body(token)
        if kind == "end":
            return self.end_in_body(token[1])
        return False

    def start_in_body(self, token: tuple) -> bool:
        _, name, attrs, selfclosing = token
        if name == "html":
            have = {k for k, _ in self.stack[0].attrs}
            self.stack[0].attrs += [a for a in attrs if a[0] not in have]
        elif name in HEAD:
            return self.in_head(token)
        elif name == "body":
            if len(self.stack) > 1 and self.stack[1].tag == "body":
                self.frames_ok = False
                have = {k for k, _ in self.stack[1].attrs}
                self.stack[1].attrs += [a for a in attrs if a[0] not in have]
        elif name == "frameset":
            if self.frames_ok and len(self.stack) > 1 and self.stack[1].tag == "body":
                self.stack[1].detach()
                del self.stack[1:]
                self.put(token)
                self.mode = self.in_frameset
        elif name in BLOCKS:
            self.close_p()
            self.put(token)
        elif name in HEADINGS:
            self.close_p()
            if self.top.tag in HEADINGS:
                self.stack.pop()
            self.put(token)
        elif name in ("pre", "listing"):
            self.close_p()
            self.put(token)
            self.skip_newline, self.frames_ok = True, False
        elif name == "form":
            if self.form is None or self.templates:
                self.close_p()
                node = self.put(token)
                if not self.templates:
                    self.form = node
        elif name in ("li", "dd", "dt"):
            self.frames_ok = False
            ends = ("li",) if name == "li" else ("dd", "dt")
            for n in reversed(self.stack):
                if n.tag in ends and not n.space:
                    self.imply(n.tag)
                    self.pop_to(n.tag)
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.put(token)
        elif name == "plaintext":
            self.close_p()
            self.put(token)
        elif name == "button":
            if self.scope(("button",)):
                self.imply()
                self.pop_to("button")
            self.reconstruct()
            self.put(token)
            self.frames_ok = False
        elif name == "a":
            for own in reversed(self.active):
                if own is None:
                    break
                if own.tag == "a":
                    self.adopt("a")
                    if own in self.active:
                        self.active.remove(own)
                    if own in self.stack:
                        self.stack.remove(own)
                    break
            self.reconstruct()
            self.remember(self.put(token))
        elif name in FORMATTING:
            self.reconstruct()
            if name == "nobr" and self.scope(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.put(token))
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.put(token)
            self.active.append(None)
            self.frames_ok = False
        elif name == "table":
            doctype = next((c.text.lower() for c in self.root.children if c.kind == DOCTYPE), None)
            if not (doctype is None or doctype.split()[:1] != ["html"] or "-//w3c//dtd html 4.01 transitional" in doctype and "http" not in doctype):
                self.close_p()  # in a page without its doctype a table stays in the paragraph
            self.put(token)
            self.frames_ok, self.mode = False, self.in_table
        elif name in ("area", "br", "embed", "img", "image", "keygen", "wbr", "input"):
            self.reconstruct()
            self.open("img" if name == "image" else name, attrs)
            self.stack.pop()
            if name != "input" or next((v for k, v in attrs if k == "type"), "").lower() != "hidden":
                self.frames_ok = False
        elif name in ("param", "source", "track"):
            self.put(token)
            self.stack.pop()
        elif name == "hr":
            self.close_p()
            self.put(token)
            self.stack.pop()
            self.frames_ok = False
        elif name in ("textarea", "xmp", "iframe", "noembed"):
            if name == "xmp":
                self.close_p()
                self.reconstruct()
            self.put(token)
            self.skip_newline = name == "textarea"
            self.mode, self.back, self.frames_ok = self.in_text, self.mode, False
        elif name == "select":
            self.reconstruct()
            self.put(token)
            self.frames_ok, self.mode = False, self.in_select
        elif name in ("optgroup", "option"):
            if self.top.tag == "option":
                self.stack.pop()
            self.reconstruct()
            self.put(token)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.scope(("ruby",)):
                self.imply("rtc" if name in ("rp", "rt") else "")
            self.put(token)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.open(name, self.foreign_attrs(attrs), name)
            if selfclosing:
                self.stack.pop()
        elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            pass
        else:
            self.reconstruct()
            self.put(token)
        return False

    def end_in_body(self, name: str) -> bool:
        if name == "template":
            self.end_template()
        elif name in ("body", "html"):
            if self.scope(("body",)):
                self.mode = self.after_body
                return name == "html"
        elif name in BLOCKS and name != "p" or name in ("button", "listing", "pre"):
            if self.scope((name,)):
                self.imply()
                self.pop_to(name)
        elif name == "form":
            node, self.form = self.form, None
            if self.templates:
                if self.scope(("form",)):
                    self.imply()
                    self.pop_to("form")
            elif node is not None and node in self.stack and self.scope(("form",)):
                self.imply()
                if node in self.stack:
                    self.stack.remove(node)
        elif name == "p":
            if not self.scope(("p",), frozenset(("button",))):
                self.open("p")
            self.imply("p")
            self.pop_to("p")
        elif name == "li":
            if self.scope(("li",), frozenset(("ol", "ul"))):
                self.imply("li")
                self.pop_to("li")
        elif name in ("dd", "dt"):
            if self.scope((name,)):
                self.imply(name)
                self.pop_to(name)
        elif name in HEADINGS:
            if self.scope(HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif name in FORMATTING:
            self.adopt(name)
        elif name in ("applet", "marquee", "object"):
            if self.scope((name,)):
                self.imply()
                self.pop_to(name)
                self.to_marker()
        elif name == "br":
            self.reconstruct()
            self.open("br")
            self.stack.pop()
        else:
            self.any_end(name)
        return False

    # -- tables

    _TABLE_SCOPE = frozenset(("html", "table", "template"))

    def table_scope(self, *tags: str) -> bool:
        return self.scope(tags, only=self._TABLE_SCOPE)

    def fostered(self, token: tuple) -> bool:
        self.foster = True
        again = self.in_body(token)
        self.foster = False
        return again

    def in_table(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text":
            if self.top.tag in ("table", "tbody", "tfoot", "thead", "tr") and not token[1].strip(SPACES):
                self.text(token[1])
                return False
            return self.fostered(token)
        if kind == "start":
            name = token[1]
            if name == "caption":
                self.clear_to("table", "template", "html")
                self.active.append(None)
                self.put(token)
                self.mode = self.in_caption
            elif name == "colgroup":
                self.clear_to("table", "template", "html")
                self.put(token)
                self.mode = self.in_columns
            elif name == "col":
                self.clear_to("table", "template", "html")
                self.open("colgroup")
                self.mode = self.in_columns
                return True
            elif name in TABLE_PARTS:
                self.clear_to("table", "template", "html")
                self.put(token)
                self.mode = self.in_table_body
            elif name in ("td", "th", "tr"):
                self.clear_to("table", "template", "html")
                self.open("tbody")
                self.mode = self.in_table_body
                return True
            elif name == "table":
                if self.table_scope("table"):
                    self.pop_to("table")
                    self.reset()
                    return True
            elif name in ("style", "script", "template"):
                return self.in_head(token)
            elif name == "input" and next((v for k, v in token[2] if k == "type"), "").lower() == "hidden":
                self.put(token)
                self.stack.pop()
            elif name == "form":
                if self.form is None and not self.templates:
                    self.form = self.put(token)
                    self.stack.pop()
            else:
                return self.fostered(token)
            return False
        if kind == "end":
            name = token[1]
            if name == "table":
                if self.table_scope("table"):
                    self.pop_to("table")
                    self.reset()
                return False
            if name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr") or name in TABLE_PARTS:
                return False
            if name == "template":
                return self.in_head(token)
            return self.fostered(token)
        return False

    def in_caption(self, token: tuple) -> bool:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        ends = kind == "end" and name in ("caption", "table") or kind == "start" and (name in ("caption", "col", "colgroup", "td", "th", "tr") or name in TABLE_PARTS)
        if ends:
            if self.table_scope("caption"):
                self.imply()
                self.pop_to("caption")
                self.to_marker()
                self.mode = self.in_table
                return not (kind == "end" and name == "caption")
            return False
        if kind == "end" and (name in ("body", "col", "colgroup", "html", "td", "th", "tr") or name in TABLE_PARTS):
            return False
        return self.in_body(token)

    def in_columns(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text" and not token[1].strip(SPACES):
            self.text(token[1])
            return False
        if kind == "start" and token[1] == "col":
            self.put(token)
            self.stack.pop()
            return False
        if kind == "start" and token[1] == "template" or kind == "end" and token[1] == "template":
            return self.in_head(token)
        if kind == "end" and token[1] == "col" or kind == "doctype":
            return False
        if self.top.tag == "colgroup":
            self.stack.pop()
            self.mode = self.in_table
            return not (kind == "end" and token[1] == "colgroup")
        return False

    def in_table_body(self, token: tuple) -> bool:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        parts = ("tbody", "tfoot", "thead", "template", "html")
        if kind == "start" and name == "tr":
            self.clear_to(*parts)
            self.put(token)
            self.mode = self.in_row
            return False
        if kind == "start" and name in ("td", "th"):
            self.clear_to(*parts)
            self.open("tr")
            self.mode = self.in_row
            return True
        if kind == "end" and name in TABLE_PARTS:
            if self.table_scope(name):
                self.clear_to(*parts)
                self.stack.pop()
                self.mode = self.in_table
            return False
        if kind == "start" and (name in ("caption", "col", "colgroup") or name in TABLE_PARTS) or kind == "end" and name == "table":
            if self.table_scope("tbody", "thead", "tfoot"):
                self.clear_to(*parts)
                self.stack.pop()
                self.mode = self.in_table
                return True
            return False
        if kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return False
        return self.in_table(token)

    def in_row(self, token: tuple) -> bool:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "start" and name in ("td", "th"):
            self.clear_to("tr", "template", "html")
            self.put(token)
            self.active.append(None)
            self.mode = self.in_cell
            return False
        leaves = kind == "end" and (name in ("tr", "table") or name in TABLE_PARTS) or kind == "start" and (name in ("caption", "col", "colgroup", "tr") or name in TABLE_PARTS)
        if leaves:
            if kind == "end" and name in TABLE_PARTS and not self.table_scope(name) or not self.table_scope("tr"):
                return False
            self.clear_to("tr", "template", "html")
            self.stack.pop()
            self.mode = self.in_table_body
            return not (kind == "end" and name == "tr")
        if kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return False
        return self.in_table(token)

    def in_cell(self, token: tuple) -> bool:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "end" and name in ("td", "th"):
            if self.table_scope(name):
                self.imply()
                self.pop_to(name)
                self.to_marker()
                self.mode = self.in_row
            return False
        opens = kind == "start" and (name in ("caption", "col", "colgroup", "td", "th", "tr") or name in TABLE_PARTS)
        closes = kind == "end" and (name in ("table", "tr") or name in TABLE_PARTS)
        if opens and self.table_scope("td", "th") or closes and self.table_scope(name):
            self.imply()
            self.pop_to("td", "th")
            self.to_marker()
            self.mode = self.in_row
            return True
        if opens or closes or kind == "end" and name in ("body", "caption", "col", "colgroup", "html"):
            return False
        return self.in_body(token)

    # -- others

    def in_select(self, token: tuple) -> bool:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "text":
            self.text(name.replace("\0", ""))
        elif kind == "start":
            if name == "option":
                if self.top.tag == "option":
                    self.stack.pop()
                self.put(token)
            elif name in ("optgroup", "hr"):
                if self.top.tag == "option":
                    self.stack.pop()
                if self.top.tag == "optgroup":
                    self.stack.pop()
                self.put(token)
                if name == "hr":
                    self.stack.pop()
            elif name == "select":
                self.pop_to("select")
                self.reset()
            elif name in ("input", "keygen", "textarea") or name in ("caption", "table", "td", "th", "tr") or name in TABLE_PARTS:
                if any(n.tag == "select" for n in self.stack):
                    self.pop_to("select")
                    self.reset()
                    return True
            elif name in ("script", "template"):
                return self.in_head(token)
        elif kind == "end":
            if name == "option" and self.top.tag == "option":
                self.stack.pop()
            elif name == "optgroup":
                if self.top.tag == "option" and len(self.stack) > 1 and self.stack[-2].tag == "optgroup":
                    self.stack.pop()
                if self.top.tag == "optgroup":
                    self.stack.pop()
            elif name == "select":
                self.pop_to("select")
                self.reset()
            elif name == "template":
                return self.in_head(token)
            elif name in ("caption", "table", "td", "th", "tr") or name in TABLE_PARTS:
                if self.table_scope(name):
                    self.pop_to("select")
                    self.reset()
                    return True
        return False

    def in_template(self, token: tuple) -> bool:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "start" and name not in HEAD:
            mode = self.in_table if name in ("caption", "colgroup") or name in TABLE_PARTS else self.in_columns if name == "col" else self.in_table_body if name == "tr" else self.in_row if name in ("td", "th") else self.in_body
            if self.templates:
                self.templates[-1] = mode
            self.mode = mode
            return True
        if kind == "end":
            if name == "template":
                return self.in_head(token)
            return False
        return self.in_body(token)

    def after_body(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text" and not token[1].strip(SPACES):
            return self.in_body(token)
        if kind == "end" and token[1] == "html":
            self.mode = self.after_after_body
            return False
        if kind in ("doctype", "eof"):
            return False
        self.mode = self.in_body
        return True

    def after_after_body(self, token: tuple) -> bool:
        if token[0] == "text" and not token[1].strip(SPACES):
            return self.in_body(token)
        if token[0] in ("doctype", "eof"):
            return False
        self.mode = self.in_body
        return True

    def in_frameset(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text":
            self.text("".join(c for c in token[1] if c in SPACES))
        elif kind == "start" and token[1] == "frameset":
            self.put(token)
        elif kind == "start" and token[1] == "frame":
            self.put(token)
            self.stack.pop()
        elif kind == "start" and token[1] == "noframes":
            return self.in_head(token)
        elif kind == "end" and token[1] == "frameset" and len(self.stack) > 1:
            self.stack.pop()
        return False

    # -- foreign content

    def foreign_attrs(self, attrs: list[list[str]]) -> list[list[str]]:
        return attrs

    def integration(self, token: tuple) -> bool:
        """Whether a token in foreign content is read as HTML."""
        top, kind = self.top, token[0]
        if kind == "eof":
            return True
        if top.space == "math" and top.tag in ("mi", "mo", "mn", "ms", "mtext"):
            return kind == "text" or kind == "start" and token[1] not in ("mglyph", "malignmark")
        if top.space == "math" and top.tag == "annotation-xml":
            encoding = next((v.lower() for k, v in top.attrs if k == "encoding"), "")
            return kind == "start" and token[1] == "svg" or encoding in ("text/html", "application/xhtml+xml") and kind in ("start", "text")
        return top.space == "svg" and top.tag in ("foreignobject", "foreignObject", "desc", "title") and kind in ("start", "text")

    def in_foreign(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text":
            self.text(token[1].replace("\0", "�"))
            return False
        if kind == "start":
            name = token[1]
            if name in BREAKOUT or name == "font" and any(k in ("color", "face", "size") for k, _ in token[2]):
                while self.top.space and not (self.top.space == "svg" and self.top.tag in ("foreignObject", "foreignobject", "desc", "title") or self.top.space == "math" and self.top.tag in ("mi", "mo", "mn", "ms", "mtext")):
                    self.stack.pop()
                return True
            tag = "foreignObject" if self.top.space == "svg" and name == "foreignobject" else name
            self.open(tag, token[2], self.top.space)
            if token[3]:
                self.stack.pop()
            return False
        if kind == "end":
            name = token[1]
            if name in ("br", "p"):
                while self.top.space:
                    self.stack.pop()
                return True
            for i in range(len(self.stack) - 1, -1, -1):
                n = self.stack[i]
                if not n.space:
                    return self.mode(token)
                if n.tag.lower() == name:
                    del self.stack[i:]
                    return False
        return False


def parse(page: str) -> Node:
    """The document of a page."""
    return TreeBuilder().feed(page.translate(_CHARSET) if "\0" in page else page)


def parse_fragment(markup: str) -> list[Node]:
    """The nodes of markup as if it were set inside a div."""
    top = TreeBuilder("div").feed(markup).children[0]
    out = list(top.children)
    for n in out:
        n.detach()
    return out


_ESCAPE = str.maketrans({"&": "&amp;", "'": "&#39;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "\r": "&#13;"})


def serialize(nodes: list[Node]) -> str:
    """Markup of nodes. Empty elements are closed in place, quotes are written as references."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == TEXT:
            own = n.parent
            out.append(n.text if own is not None and own.kind == ELEMENT and (own.tag in RAW or own.tag == "plaintext") and not own.space else n.text.translate(_ESCAPE))
        elif n.kind == COMMENT:
            out.append(f"<!--{n.text}-->")
        elif n.kind == DOCTYPE:
            out.append(f"<!DOCTYPE {n.text}>")
        elif n.kind == DOCUMENT:
            todo.extend(reversed(n.children))
        else:
            out.append(f"<{n.tag}" + "".join(f' {k}="{v.translate(_ESCAPE)}"' for k, v in n.attrs))
            if n.tag in VOID and not n.space:
                out.append("/>")
                continue
            out.append(">")
            first = n.children[0] if n.children else None
            if first is not None and first.kind == TEXT and first.text[:1] == "\n" and n.tag in ("pre", "listing", "textarea"):
                out.append("\n")
            todo.append(f"</{n.tag}>")
            todo.extend(reversed(n.children))
    return "".join(out)


def has_explicit_body(page: str) -> tuple[bool, bool, bool]:
    """Whether a page has html, head and body start tags of its own."""
    found = set()
    source, answer = tokens(page), None
    while True:
        try:
            token = source.send(answer)
        except StopIteration:
            break
        answer = None
        if token[0] == "start":
            found.add(token[1])
            answer = token[1] if token[1] in RAW or token[1] in ESCAPABLE_RAW else None
            if token[1] == "body":
                break
    return "html" in found, "head" in found, "body" in found
