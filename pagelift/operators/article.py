"""Extraction of a page's main article: candidates are scored, the best one and its like are joined and cleaned.

An attempt with too short a text is followed by one with a rule less: first without dropping unlikely names, then
without weighing names, then without the conditional cleaning. Each begins with the page's tree as it was parsed.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pagelift.functions import matchers, urls
from pagelift.functions.text import paragraph_score, plain, similarity, trim, utf16
from pagelift.sources.html import ELEMENT, TEXT, Node, has_explicit_body, parse, serialize

from . import metadata, prepare
from .clean import Rules, clean_article
from .dom import ancestors, below, element, elements, first, following, get, has_block_inside, holds_only, inner_text, is_blank, is_hollow, is_phrasing, is_visible, link_density, only_element, put, remove_and_follow, retag, text, text_length, under

log = logging.getLogger("pagelift")
log.addHandler(logging.NullHandler())

# Element names, roles, points and limits of the scoring rules.
SCORED = frozenset("section h2 h3 h4 h5 h6 p td pre".split())
UNLIKELY_ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog".split())
MAY_BE_HOLLOW = frozenset("div section header h1 h2 h3 h4 h5 h6".split())
JOINED_AS_THEY_ARE = frozenset("div article section p".split())
POINTS = {"div": 5.0} | dict.fromkeys(("pre", "td", "blockquote"), 3.0) | dict.fromkeys("address ol ul dl dd dt li form".split(), -3.0) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5.0)
PAGE_CLASS = "page"
LEAST_PARAGRAPH, ANCESTORS, CLOSE, CLOSE_COUNT = 25, 5, 0.75, 3


@dataclass(frozen=True)
class Options:
    """Settings of extraction; zero elements means no limit, a zero threshold no retries."""

    max_elements: int = 0
    top_candidates: int = 5
    char_threshold: int = 500
    classes_to_preserve: tuple[str, ...] = ("page",)
    keep_classes: bool = False
    disable_json_ld: bool = False
    allowed_video: str | None = None
    link_density_modifier: float = 0.0
    page_id: str = "page-1"
    debug: bool = False


class Failed(Exception):
    """A page without a result: its status, and the counts of a page with too many elements."""

    def __init__(self, status: str, count: int | None = None, most: int | None = None):
        super().__init__(status if count is None else f"{count} elements exceeds maximum {most}")
        self.status, self.count, self.most = status, count, most


@dataclass
class Article:
    title: str
    byline: str
    dir: str
    lang: str
    content: str
    text_content: str
    length: int
    excerpt: str
    site_name: str
    published_time: str
    attempts: int = 1


@dataclass
class Attempt:
    """One run over a fresh tree."""

    doc: Node
    title: str
    byline: str
    options: Options
    unlikely: bool
    weigh: bool
    conditional: bool
    scores: dict[Node, float] = field(default_factory=dict)
    lang: str = ""

    def __post_init__(self) -> None:
        self.body = first(self.doc, "body")
        self.root = first(self.doc, "html") or self.body

    # -- the walk

    def _takes_byline(self, n: Node, class_: str, id_: str) -> bool:
        if self.byline:
            return False
        if not (get(n, "rel") == "author" or "author" in get(n, "itemprop") or matchers.byline(class_) or matchers.byline(id_)):
            return False
        if not 0 < utf16(trim(text(n))) < 100:
            return False
        named = next((x for x in below(n) if get(x, "itemprop") == "name"), n)
        self.byline = trim(text(named))
        return True

    def _repeats_title(self, n: Node) -> bool:
        return n.tag in ("h1", "h2") and similarity(self.title, trim(text(n))) > 0.75

    def _is_unlikely(self, n: Node, class_: str, id_: str) -> bool:
        return matchers.dropped_as_unlikely(class_, id_) and n.tag not in ("body", "a") and not under(n, "table", 4) and not under(n, "code", 4)

    def _goes(self, n: Node) -> bool:
        """Whether an element is no part of the article by itself; the first of the rules that holds counts."""
        class_, id_ = get(n, "class"), get(n, "id")
        if not is_visible(n) or get(n, "aria-modal") == "true" and get(n, "role") == "dialog" or self._takes_byline(n, class_, id_):
            return True
        if not self._title_gone and self._repeats_title(n):
            self._title_gone = True
            return True
        return self.unlikely and self._is_unlikely(n, class_, id_) or get(n, "role") in UNLIKELY_ROLES or n.tag in MAY_BE_HOLLOW and is_hollow(n)

    @staticmethod
    def _wrap_phrases(div: Node) -> None:
        """Runs of phrasing content in a division become paragraphs."""
        p = None
        for c in list(div.children):
            if is_phrasing(c):
                if p is not None:
                    p.append(c)
                elif not is_blank(c):
                    p = element("p")
                    c.replace_with(p)
                    p.append(c)
            elif p is not None:
                while p.children and is_blank(p.children[-1]):
                    p.children[-1].detach()
                p = None

    def walk(self) -> list[Node]:
        """Take out what is no content, and return the elements to be scored."""
        found, n = [], self.root
        self._title_gone = False
        while n is not None:
            if n.tag == "html":
                self.lang = get(n, "lang")
            if self._goes(n):
                n = remove_and_follow(n)
                continue
            if n.tag in SCORED:
                found.append(n)
            if n.tag == "div":
                self._wrap_phrases(n)
                if holds_only(n, "p") and link_density(n) < 0.25:
                    child = only_element(n)
                    n.replace_with(child)
                    n = child
                    found.append(n)
                elif not has_block_inside(n):
                    retag(n, "p")
                    found.append(n)
            n = following(n)
        return found

    # -- scores

    def points(self, n: Node) -> float:
        return POINTS.get(n.tag, 0.0) + (matchers.class_weight(get(n, "class"), get(n, "id")) if self.weigh else 0)

    def score(self, paragraphs: list[Node]) -> list[Node]:
        """Scores of the ancestors of paragraphs; returns them in the order in which they were first met."""
        met = []
        for p in paragraphs:
            own = inner_text(p) if p.parent is not None else ""
            if utf16(own) < LEAST_PARAGRAPH:
                continue
            points = paragraph_score(own)
            for level, a in enumerate(ancestors(p)[:ANCESTORS]):
                if a.kind != ELEMENT or a.parent is None or a.parent.kind != ELEMENT:
                    continue
                if a not in self.scores:
                    self.scores[a] = self.points(a)
                    met.append(a)
                self.scores[a] += points / (1, 2, 6, 9, 12)[level]
        return met

    def best(self, met: list[Node]) -> list[Node]:
        """The candidates with most points, less their share of links; of equal ones the first met."""
        for n in met:
            self.scores[n] *= 1 - link_density(n)
        return sorted(met, key=lambda n: -self.scores[n])[: max(0, self.options.top_candidates)]

    def choose(self, best: list[Node]) -> tuple[Node, bool]:
        """The top candidate, and whether it was made for want of one."""
        if not best or best[0].tag == "body":
            top = element("div")
            for c in list(self.body.children):
                top.append(c)
            self.body.append(top)
            self.scores[top] = self.points(top)
            return top, True
        top = best[0]
        close = [set(ancestors(n)) for n in best[1:] if self.scores[top] and self.scores[n] / self.scores[top] >= CLOSE]
        if len(close) >= CLOSE_COUNT:
            for a in ancestors(top):
                if a.tag == "body":
                    break
                if sum(a in own for own in close) >= CLOSE_COUNT:
                    top = a
                    break
        self.scores.setdefault(top, self.points(top))
        last, least = self.scores[top], self.scores[top] / 3
        for a in ancestors(top):
            if a.tag == "body":
                break
            if a not in self.scores:
                continue
            if self.scores[a] < least:
                break
            if self.scores[a] > last:
                top = a
                break
            last = self.scores[a]
        while top.parent is not None and top.parent.tag != "body" and only_element(top.parent) is not None:
            top = top.parent
        self.scores.setdefault(top, self.points(top))
        return top, False

    def _joins(self, n: Node, top: Node, limit: float) -> bool:
        if n is top:
            return True
        bonus = self.scores[top] * 0.2 if get(top, "class") and get(n, "class") == get(top, "class") else 0.0
        if n in self.scores and self.scores[n] + bonus >= limit:
            return True
        if n.tag != "p":
            return False
        own, density = inner_text(n), link_density(n)
        length = utf16(own)
        return length > 80 and density < 0.25 or length < 80 and density == 0 and (". " in own or own.endswith("."))

    def run(self, rules: Rules) -> tuple[Node | None, list[Node]]:
        """The article, and the elements that say its direction."""
        if self.body is None:
            return None, []
        top, made = self.choose(self.best(self.score(self.walk())))
        parent, limit = top.parent, max(10.0, self.scores[top] * 0.2)
        article = element("div")
        for n in elements(parent):
            if self._joins(n, top, limit):
                if n.tag not in JOINED_AS_THEY_ARE:
                    retag(n, "div")
                article.append(n)
        clean_article(article, rules)
        page = top
        if not made:
            page = element("div")
            for c in list(article.children):
                page.append(c)
            article.append(page)
        put(page, "id", self.options.page_id)
        put(page, "class", PAGE_CLASS)
        return article, [parent, top, *ancestors(parent)]


def check_url(url: str) -> None:
    if url and not urls.valid_page_url(url):
        raise Failed("invalid_url")


def parse_page(page: str) -> Node:
    """The tree of a page; fails for one that says html and head, but has no body."""
    doc = parse(page)
    body = first(doc, "body")
    if body is None:
        raise Failed("no_body")
    if not any(c.kind == ELEMENT or c.kind == TEXT and trim(c.text) for c in body.children):
        has_html, has_head, has_body = has_explicit_body(page)
        if has_html and has_head and not has_body:
            raise Failed("no_body")
    return doc


def _pieces(article: Node) -> list[tuple[str, bool]]:
    """Texts in document order, and whether they stand in preformatted elements."""
    out, todo = [], [(article, False)]
    while todo:
        n, verbatim = todo.pop()
        if n.kind == TEXT:
            out.append((n.text, verbatim))
            continue
        verbatim = verbatim or n.kind == ELEMENT and n.tag in ("pre", "textarea")
        todo.extend((c, verbatim) for c in reversed(n.children))
    return out


def extract(fresh: Callable[[], Node], url: str = "", options: Options = Options()) -> Article:  # noqa: B008
    """The article of a tree. fresh gives the tree as it was parsed, each time anew; it may be changed."""
    doc = fresh()
    if first(doc, "body") is None:
        raise Failed("no_body")
    check_url(url)
    if options.max_elements > 0 and (count := len(below(doc))) > options.max_elements:
        raise Failed("too_many_elements", count, options.max_elements)
    video = re.compile(options.allowed_video or matchers.VIDEOS)
    prepare.plain_math(doc)
    prepare.unwrap_noscript_images(doc)
    found = None if options.disable_json_ld else metadata.json_ld(metadata.scripts(doc), lambda: metadata.page_title(doc))
    prepare.prepare(doc, first(doc, "body"))
    meta = metadata.page_metadata(doc, found)

    kept: list[tuple[int, Node]] = []
    byline, stages = "", [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]
    for tries, (unlikely, weigh, conditional) in enumerate(stages, 1):
        if tries > 1:
            doc = fresh()
            prepare.plain_math(doc)
            prepare.unwrap_noscript_images(doc)
            prepare.prepare(doc, first(doc, "body"))
        run = Attempt(doc, meta.title, byline, options, unlikely, weigh, conditional)
        article, around = run.run(Rules(video, options.link_density_modifier, weigh, conditional, set()))
        byline = run.byline
        if article is None:
            raise Failed("no_content")
        length = text_length(article)
        if options.debug:
            log.debug("attempt %d: %d units", tries, length)
        if length >= options.char_threshold:
            break
        kept.append((length, article))
        if tries == len(stages):
            length, article = max(kept, key=lambda x: x[0])
            if not length:
                raise Failed("no_content")
    direction = next((d for n in around if n.kind == ELEMENT and (d := get(n, "dir"))), "")
    # The base element of the last tree counts.
    prepare.absolute_links(article, prepare.base_uri(doc, url), url)
    prepare.simplify(article, next((n for n in article.walk() if n.kind == ELEMENT and get(n, "id") == options.page_id), None))
    if not options.keep_classes:
        prepare.clean_classes(article, options.classes_to_preserve)
    paragraphs = below(article, "p")
    excerpt = meta.excerpt or (trim(text(paragraphs[0])) if paragraphs else "")
    whole = plain(_pieces(article))
    return Article(meta.title, meta.byline or byline, direction, run.lang, serialize(article.children), whole, utf16(whole), excerpt, meta.site_name, meta.published_time, tries)


def extract_page(page: str, url: str = "", options: Options = Options()) -> Article:  # noqa: B008
    """The article of a page's markup."""
    doc = parse_page(page)
    state = {"doc": doc}

    def fresh() -> Node:
        own, state["doc"] = state["doc"], None
        return own if own is not None else parse(page)

    return extract(fresh, url, options)


def extract_node(root: Node, url: str = "", options: Options = Options()) -> Article:  # noqa: B008
    """The article of a tree, which stays as it is."""
    return extract(root.clone, url, options)
