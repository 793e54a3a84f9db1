"""Whether a page is probably an article, by the lengths of its visible paragraphs: Python, for single trees."""

from __future__ import annotations

import math

from pagelift.functions import matchers
from pagelift.sources.html import ELEMENT, Node

from .dom import below, first, get, is_visible, trimmed_length, under

# Default limits, and the elements that count by their tag alone.
MIN_SCORE, MIN_LENGTH = 20.0, 140
COUNTED = ("p", "pre", "article")


def probably_article(doc: Node, min_score: float = MIN_SCORE, min_length: int = MIN_LENGTH) -> bool:
    if first(doc, "body") is None:
        return False
    rows = [n for n in below(doc) if n.tag in COUNTED]
    rows += [n for n in below(doc, "div") if any(c.kind == ELEMENT and c.tag == "br" for c in n.children)]
    score = 0.0
    for n in rows:
        if not is_visible(n) or matchers.dropped_as_unlikely(get(n, "class"), get(n, "id")) or n.tag == "p" and under(n, "li"):
            continue
        length = trimmed_length(n)
        if length >= min_length:
            score += math.sqrt(length - min_length)
            if score > min_score:
                return True
    return False
