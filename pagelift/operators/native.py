"""Operators as Spark expressions over columns and node tables: no Python, no shuffle unless an aggregate asks for it.

A node table's row has a page's nodes as an array in document order, so what is below a node is a slice of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelift.functions import matchers
from pagelift.functions import text as X
from pagelift.operators import metadata as M
from pagelift.sources.html import ELEMENT, TEXT

from .readable import COUNTED, MIN_LENGTH, MIN_SCORE


def attribute(attrs: Column, name: str) -> Column:
    """The first attribute of that name, '' if there is none."""
    return F.coalesce(F.get(F.filter(attrs, lambda a: F.lower(a["key"]) == name), F.lit(0))["val"], F.lit(""))


def has_attribute(attrs: Column, name: str) -> Column:
    return F.exists(attrs, lambda a: F.lower(a["key"]) == name)


def tagged(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: (n["kind"] == ELEMENT) & n["tag"].isin(*tags))


def below(nodes: Column, n: Column) -> Column:
    """The nodes below a node."""
    return F.slice(nodes, n["id"] + 2, n["last_id"] - n["id"])


def text_of(nodes: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.filter(below(nodes, n), lambda x: x["kind"] == TEXT), lambda x: x["text"]), "")


def covered(nodes: Column, *tags: str) -> Column:
    """Ids of the nodes from each outermost element of the tags to the last below it."""
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("firsts"))

    def outermost(s: Column, x: Column) -> Column:
        return F.when(x["id"] > s["end"], F.struct(x["last_id"].alias("end"), F.concat(s["firsts"], F.array(x["id"])).alias("firsts"))).otherwise(s)

    firsts = F.aggregate(tagged(nodes, *tags), start, outermost, lambda s: s["firsts"])
    return F.flatten(F.transform(firsts, lambda i: F.sequence(i, F.get(nodes, i)["last_id"])))


def style(value: Column, name: str) -> Column:
    """An inline style's value: the last declaration, unless an important one stands against it."""
    start = F.struct(F.lit("").alias("value"), F.lit(False).alias("important"))

    def step(state: Column, part: Column) -> Column:
        key = F.lower(X.trim_col(F.substring_index(part, ":", 1)))
        given = X.trim_col(F.regexp_replace(part, "(?s)^[^:]*:", ""))
        weighty = given.rlike("(?i)![\\s\\x{0B}\\x{85}\\x{A0}]*i\\s*m\\s*p\\s*o\\s*r\\s*t\\s*a\\s*n\\s*t\\s*\\z")
        plain = F.when(weighty, X.trim_col(F.regexp_replace(given, "![^!]*\\z", ""))).otherwise(given)
        ours = (F.instr(part, ":") > 0) & (key == name) & (weighty | ~state["important"])
        return F.when(ours, F.struct(plain.alias("value"), weighty.alias("important"))).otherwise(state)

    return F.aggregate(F.split(value, ";"), start, step, lambda s: s["value"])


def is_visible(attrs: Column) -> Column:
    inline = attribute(attrs, "style")
    shown = (F.lower(style(inline, "display")) != "none") & (F.lower(style(inline, "visibility")) != "hidden") & ~has_attribute(attrs, "hidden")
    return shown & ((F.lower(attribute(attrs, "aria-hidden")) != "true") | F.contains(attribute(attrs, "class"), F.lit("fallback-image")))


def readable_score(nodes: Column, min_length: int = MIN_LENGTH) -> Column:
    """Sum of the roots of the lengths, beyond the least, of the candidates that are long enough (null: there is none)."""
    ids = lambda *tags: F.transform(tagged(nodes, *tags), lambda n: n["id"])
    # Sets of ids are hashed, so a page costs as much as its nodes.
    with_break = F.array_intersect(ids("div"), F.transform(tagged(nodes, "br"), lambda b: b["parent"]))
    in_list = F.array_intersect(ids("p"), covered(nodes, "li"))
    chosen = F.transform(F.array_except(F.array_sort(F.concat(ids(*COUNTED), with_break)), in_list), lambda i: F.get(nodes, i))
    kept = F.filter(chosen, lambda n: is_visible(n["attrs"]) & ~matchers.dropped_as_unlikely_col(attribute(n["attrs"], "class"), attribute(n["attrs"], "id")))
    lengths = F.filter(F.transform(kept, lambda n: X.utf16_col(X.trim_col(text_of(nodes, n)))), lambda x: x >= min_length)
    return F.when(F.size(lengths) > 0, F.aggregate(lengths, F.lit(0.0), lambda s, x: s + F.sqrt((x - min_length).cast("double"))))


def probably_articles(tables: DataFrame, min_score: float = MIN_SCORE, min_length: int = MIN_LENGTH, nodes_col: str = "nodes") -> DataFrame:
    """tables with a column readable: whether the page is probably an article."""
    nodes = F.col(nodes_col)
    score = readable_score(nodes, min_length)
    has_body = F.exists(nodes, lambda n: (n["kind"] == ELEMENT) & (n["tag"] == "body"))
    return tables.withColumn("readable", F.coalesce(has_body & (score > min_score), F.lit(False)))


def element_count(nodes: Column) -> Column:
    return F.size(F.filter(nodes, lambda n: n["kind"] == ELEMENT))


def page_lang(nodes: Column) -> Column:
    found = tagged(nodes, "html")
    return F.when(F.size(found) > 0, attribute(found[0]["attrs"], "lang")).otherwise("")


def link_density(nodes: Column, n: Column) -> Column:
    """Share of a node's text that stands in links; links within the page count less."""
    total = X.utf16_col(X.inner_col(text_of(nodes, n)))
    links = F.filter(below(nodes, n), lambda a: (a["kind"] == ELEMENT) & (a["tag"] == "a"))

    def part(s: Column, a: Column) -> Column:
        href = attribute(a["attrs"], "href")
        return s + X.utf16_col(X.inner_col(text_of(nodes, a))) * F.when((F.length(href) > 1) & href.startswith("#"), 0.3).otherwise(1.0)

    return F.coalesce(F.try_divide(F.aggregate(links, F.lit(0.0), part), total.cast("double")), F.lit(0.0))


def table_kind(role: Column, datatable: Column, summary: Column, caption: Column, parts: Column, nested: Column, rows: Column, columns: Column) -> Column:
    """Whether a table holds data, by its attributes, parts and size."""
    return (
        F.when((role == "presentation") | (datatable == "0"), False)
        .when((summary != "") | caption | parts, True)
        .when(nested, False)
        .otherwise((rows >= 10) | (columns > 4) | (rows * columns > 10))
    )


def fishy(tag: Column, weight: Column, h: dict[str, Column], modifier: float = 0.0) -> Column:
    """The conditional rules over an element's holdings (columns by the names of clean.Holdings, and in_figure)."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    is_list = tag.isin("ul", "ol") | (ratio(h["list_length"], h["length"]) > 0.9)
    heading = ratio(h["heading_length"], h["length"])
    wrong = (
        ((h["images"] > 1) & (ratio(h["paragraphs"], h["images"]) < 0.5) & ~h["in_figure"])
        | (~is_list & (h["items"] - 100 > h["paragraphs"]))
        | (h["inputs"] > F.floor(h["paragraphs"] / 3))
        | (~is_list & (heading < 0.9) & (h["length"] < 25) & ((h["images"] == 0) | (h["images"] > 2)) & ~h["in_figure"])
        | (~is_list & (weight < 25) & (h["link_density"] > 0.2 + modifier))
        | ((weight >= 25) & (h["link_density"] > 0.5 + modifier))
        | ((h["embeds"] == 1) & (h["length"] < 75))
        | (h["embeds"] > 1)
    )
    return F.when(weight < 0, True).when((h["commas"] >= 10) | h["video"], False).otherwise(wrong)


def title(title: Column, h1: Column, h2: Column) -> Column:
    """The heuristic title. title: inner text of the title element ('' if none); h1, h2: arrays of headings' texts."""
    signs = M._SIGNS
    count = lambda c: F.size(F.split(c, X.ASCII_CLASS + "+", -1))
    padded, hierarchical = title.rlike(f" [{signs}] "), title.rlike(r" [\\/>»] ")
    before = F.regexp_extract(title, f"([^\n]*)[{signs}] [^\n]*", 1)
    cut = F.when(count(before) < 3, F.regexp_replace(title, f"^[^{signs}]*[{signs}]", "")).otherwise(before)
    after_last = F.substring_index(title, ":", -1)
    after_first = F.regexp_replace(title, "^[^:]*:", "")
    matched = F.array_contains(F.transform(F.concat(h1, h2), X.trim_col), X.trim_col(title))
    chosen = F.when(matched, title).otherwise(after_last)
    colon = F.when(count(chosen) < 3, after_first).when(count(F.substring_index(title, ":", 1)) > 5, title).otherwise(chosen)
    size = X.utf16_col(title)
    heading = F.when(((size > 150) | (size < 15)) & (F.size(h1) == 1), X.inner_col(F.get(h1, F.lit(0)))).otherwise(title)
    now = X.inner_col(F.when(padded, cut).when(F.contains(title, F.lit(": ")), colon).otherwise(heading))
    few = (count(now) <= 4) & (~(padded & hierarchical) | (count(now) != count(F.regexp_replace(title, f"[{signs}]+", ""))))
    return F.when(few, title).otherwise(now)


def page_title(nodes: Column) -> Column:
    texts = lambda tag: F.transform(tagged(nodes, tag), lambda n: text_of(nodes, n))
    return title(F.coalesce(X.inner_col(F.get(texts("title"), F.lit(0))), F.lit("")), texts("h1"), texts("h2"))


def meta_key(name: Column, prop: Column) -> Column:
    """The key under which a meta element's content counts, null if it does not."""
    own = M._PROPERTY.pattern
    found = F.regexp_extract(prop, "(?i)" + own, 0)
    by_property = F.when((prop != "") & (found != ""), F.regexp_replace(F.lower(found), M._SPACE, ""))
    by_name = F.when((name != "") & name.rlike("(?i)" + M._NAME.pattern.replace(r"\Z", r"\z")), F.replace(F.regexp_replace(F.lower(name), M._SPACE, ""), F.lit("."), F.lit(":")))
    return F.coalesce(by_property, by_name)


def first_of(values: Column, keys: list[str]) -> Column:
    """The first value that is not empty, '' if there is none; values: a map."""
    return F.coalesce(*[F.nullif(F.element_at(values, F.lit(k)), F.lit("")) for k in keys], F.lit(""))


def meta_values(metas: Column) -> Column:
    """Map of key to content of an array of (name, property, content); later ones go over earlier ones."""
    some = F.filter(F.transform(metas, lambda m: F.struct(meta_key(m["name"], m["property"]).alias("key"), X.trim_col(m["content"]).alias("value"), (m["content"] != "").alias("ok"))), lambda e: e["ok"] & e["key"].isNotNull())
    last = lambda k: F.element_at(F.filter(some, lambda e: e["key"] == k), -1)["value"]
    keys = F.array_distinct(F.transform(some, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, last))


def kept_classes(value: Column, kept: tuple[str, ...] = ("page",)) -> Column:
    return F.array_join(F.filter(F.split(value, X.ASCII_CLASS + "+"), lambda c: c.isin(*kept)), " ")


def page_url_ok(url: Column) -> Column:
    """Screening of page URLs; null and '' mean that there is none, which is fine."""
    return F.coalesce(url == "", F.lit(True)) | F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://(?:[^/?#@\x00-\x20]*@)?(?:\[[0-9a-f:.]+\]|[^/?#@:\[\]\x00-\x20]+)(?::[0-9]*)?(?:[/?#][^\x00-\x1f\x7f]*)?\z")
