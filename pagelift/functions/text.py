"""Text functions: the Python kernel's and their twins as Spark columns.

Three kinds of white space are told apart. ASCII: space, tab, line feed, carriage return, form feed. Wide: Unicode
spaces with vertical tab and next line. Lengths count UTF-16 units.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, and the commas that score.
WIDE = "\t\n\v\f\r \x85\xa0                　"
COMMAS = ",،﹐︐︑⹁⸴⸲，"

_RUNS = re.compile("[ \t\n\r\f]{2,}")
_WIDE_RUN = re.compile(f"[{WIDE}]+")
_NOT_WORD = re.compile("[^A-Za-z0-9_]+")


def utf16(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(c > "￿" for c in text)


def trim(text: str) -> str:
    return text.strip(WIDE)


def collapse(text: str) -> str:
    """Runs of two or more ASCII spaces as one space; a single one stays what it is."""
    return _RUNS.sub(" ", text)


def inner(text: str) -> str:
    return collapse(trim(text))


def inner_length(text: str) -> int:
    return utf16(inner(text))


def commas(text: str) -> int:
    return text.count(",") if text.isascii() else sum(map(text.count, COMMAS))


def paragraph_score(text: str) -> float:
    """Points of a paragraph by its inner text: one, one for each piece between commas, one for 100 units up to 3."""
    return 2.0 + commas(text) + min(utf16(text) // 100, 3)


def similarity(a: str, b: str) -> float:
    """How much of b's words a has, by their lengths; not a number if b is empty."""
    have, words = set(_NOT_WORD.split(a.lower())), _NOT_WORD.split(b.lower())
    total = len(words) - 1 + sum(map(utf16, words))
    other = [w for w in words if w and w not in have]
    alone = sum(map(utf16, other)) + max(0, len(other) - 1)
    return 1 - alone / total if total else float("nan")


def plain(pieces: list[tuple[str, bool]]) -> str:
    """Text of (text, verbatim) pieces: runs of any space as one space, none at the ends, verbatim pieces as they are.

    Where a verbatim piece begins or ends with a space, that one separates it from what stands beside it.
    """
    out: list[str] = []
    waiting = closed = False
    for text, verbatim in pieces:
        if not text:
            continue
        if verbatim:
            if waiting and not closed and text[0] not in WIDE:
                out.append(" ")
            out.append(text)
            waiting, closed = False, text[-1] in WIDE
            continue
        words = _WIDE_RUN.sub(" ", text)
        if words == " ":
            waiting = waiting or bool(out) and not closed
            continue
        if words[0] == " ":
            waiting = waiting or bool(out) and not closed
            words = words[1:]
        if waiting and not closed:
            out.append(" ")
        waiting = words[-1] == " "
        out.append(words[:-1] if waiting else words)
        closed = False
    return "".join(out)


# Columns

ASCII_CLASS = r"[ \t\n\r\f]"
WIDE_CLASS = "[\\t\\n\\x{0B}\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, wherever it stands: the optimizer would write it into each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def utf16_col(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def trim_col(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WIDE_CLASS}+|{WIDE_CLASS}+\\z", "")


def collapse_col(c: Column) -> Column:
    return F.regexp_replace(c, ASCII_CLASS + "{2,}", " ")


def plain_col(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WIDE_CLASS + "+", " "))


def inner_col(c: Column) -> Column:
    return collapse_col(trim_col(c))


def commas_col(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, COMMAS, ""))


def paragraph_score_col(c: Column) -> Column:
    """Of inner text."""
    return (F.lit(2) + commas_col(c) + F.least(F.floor(utf16_col(c) / 100), F.lit(3))).cast("double")


def words_col(c: Column) -> Column:
    return F.split(F.lower(c), "[^A-Za-z0-9_]+")


def alone_col(a: Column, b: Column) -> Column:
    """Words of b (an array, repeats counted) that a lacks, each behind its own #.

    Words hold ASCII letters, digits and _ only, so those of both are sorted as one array, marked by ! (of a) and # (of b),
    both of which sort before all that words hold: a word of a (and an empty one) stands before its like of b, and all of
    them are cut out at once. The work is that of a sort, without a function called for each word.
    """
    marked = F.concat(F.lit("! "), F.array_join(F.array_distinct(a), "! "), F.lit("! "), F.array_join(b, "# "), F.lit("#"))
    return F.regexp_replace(F.array_join(F.sort_array(F.split(marked, " ")), ""), "(?<![A-Za-z0-9_])([A-Za-z0-9_]*+)!(?:\\1#)*+", "")


def share_col(alone: Column, b: Column) -> Column:
    """Of alone_col, and the units of b's words with a space between them; null where that is none."""
    units = F.octet_length(F.replace(alone, F.lit("#"), F.lit("")))
    return F.lit(1.0) - F.try_divide((units + F.greatest(F.octet_length(alone) - units - 1, F.lit(0))).cast("double"), b.cast("double"))


def joined_units_col(words: Column) -> Column:
    return F.octet_length(F.array_join(words, " "))


def similarity_col(a: Column, b: Column) -> Column:
    """Null where the similarity is not a number."""
    words = F.struct(words_col(a).alias("a"), words_col(b).alias("b"))
    parts = let(words, lambda w: F.struct(alone_col(w["a"], w["b"]).alias("alone"), joined_units_col(w["b"]).alias("all")))
    return let(parts, lambda p: share_col(p["alone"], p["all"]))
