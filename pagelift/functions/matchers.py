"""What class and id values, URLs and attributes say about an element: Python predicates and Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the scoring rules.
UNLIKELY = ["-ad-", "ai2html", "banner", "breadcrumbs", "combx", "comment", "community", "cover-wrap", "disqus", "extra", "footer", "gdpr", "header", "legends", "menu", "related", "remark", "replies", "rss", "shoutbox", "sidebar", "skyscraper", "social", "sponsor", "supplemental", "ad-break", "agegate", "pagination", "pager", "popup", "yom-remote"]
MAYBE = ["and", "article", "body", "column", "content", "main", "shadow"]
BYLINE = ["byline", "author", "dateline", "writtenby", "p-author"]
POSITIVE = ["article", "body", "content", "entry", "hentry", "h-entry", "main", "page", "pagination", "post", "text", "blog", "story"]
NEGATIVE = ["-ad-", "hidden", "banner", "combx", "comment", "com-", "contact", "foot", "footer", "footnote", "gdpr", "masthead", "media", "meta", "outbrain", "promo", "related", "scroll", "share", "shoutbox", "sidebar", "skyscraper", "sponsor", "shopping", "tags", "tool", "widget"]
ARTICLE_TYPES = ["Article", "AdvertiserContentArticle", "NewsArticle", "AnalysisNewsArticle", "AskPublicNewsArticle", "BackgroundNewsArticle", "OpinionNewsArticle", "ReportageNewsArticle", "ReviewNewsArticle", "Report", "SatiricalArticle", "ScholarlyArticle", "MedicalScholarlyArticle", "SocialMediaPosting", "BlogPosting", "LiveBlogPosting", "DiscussionForumPosting", "TechArticle", "APIReference"]
VIDEOS = r"(?i)//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq)\.com|(archive|upload\.wikimedia)\.org|player\.twitch\.tv)"
SHARE = r"(?i)(?<![a-z0-9])share(daddy)?(?![a-z0-9])"
HID = r"(?i)^hid\z|^hid | hid\z| hid "
IMAGE = r"\.(jpg|jpeg|png|webp)"
IMAGE_SET = r"\.(jpg|jpeg|png|webp)[ \t\n\r\f]+[0-9]"
IMAGE_ALONE = r"^[ \t\n\r\f]*[^ \t\n\r\f]+\.(jpg|jpeg|png|webp)[^ \t\n\r\f]*[ \t\n\r\f]*\Z"
SCHEMA = r"^https?://schema\.org/?\Z"


def _fold(value: str) -> str:
    """Lower case, with the two letters beyond ASCII that fold to ASCII ones."""
    return value.lower().replace("ſ", "s")


def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


_UNLIKELY, _MAYBE = (re.compile("|".join(map(re.escape, w))) for w in (UNLIKELY, MAYBE))
_BYLINE, _POSITIVE, _NEGATIVE = (re.compile("|".join(map(re.escape, w))) for w in (BYLINE, POSITIVE, NEGATIVE))
_SHARE, _HID = _python(SHARE), _python(HID)


def unlikely(value: str) -> bool:
    return bool(value) and _UNLIKELY.search(value.lower()) is not None


def maybe(value: str) -> bool:
    return bool(value) and _MAYBE.search(value.lower()) is not None


def byline(value: str) -> bool:
    return bool(value) and _BYLINE.search(_fold(value)) is not None


def positive(value: str) -> bool:
    return _POSITIVE.search(_fold(value)) is not None


def negative(value: str) -> bool:
    return _NEGATIVE.search(_fold(value)) is not None or _HID.search(value) is not None


def share(value: str) -> bool:
    return bool(value) and _SHARE.search(value) is not None


def class_weight(class_: str, id_: str) -> int:
    """25 for each of class and id that says content, less 25 for each that says something else."""
    return 25 * sum(positive(v) - negative(v) for v in (class_, id_) if v)


def dropped_as_unlikely(class_: str, id_: str) -> bool:
    return (unlikely(class_) or unlikely(id_)) and not maybe(class_) and not maybe(id_)


_JSON_TYPES = frozenset(ARTICLE_TYPES)


def article_type(value: object) -> bool:
    if isinstance(value, list):
        return any(map(article_type, value))
    return isinstance(value, str) and re.sub("^https?://schema\\.org/", "", value) in _JSON_TYPES


def javascript(uri: str) -> bool:
    from .text import trim

    return re.match("javascript:", trim(uri).translate({9: None, 10: None, 13: None}), re.IGNORECASE | re.ASCII) is not None


# Columns


def any_col(c: Column, words: list[str]) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(re.sub(r"([-.])", r"\\\1", w) for w in words))


def unlikely_col(c: Column) -> Column:
    return any_col(c, UNLIKELY)


def maybe_col(c: Column) -> Column:
    return any_col(c, MAYBE)


def byline_col(c: Column) -> Column:
    return any_col(c, BYLINE)


def share_col(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(SHARE)


def class_weight_col(class_: Column, id_: Column) -> Column:
    def one(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        return F.when(any_col(c, POSITIVE), 25).otherwise(0) - F.when(any_col(c, NEGATIVE) | c.rlike(HID), 25).otherwise(0)

    return one(class_) + one(id_)


def dropped_as_unlikely_col(class_: Column, id_: Column) -> Column:
    return (unlikely_col(class_) | unlikely_col(id_)) & ~maybe_col(class_) & ~maybe_col(id_)
