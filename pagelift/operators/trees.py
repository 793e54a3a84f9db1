"""Operators that need whole trees, as relations over the rows of node tables.

Nodes stand in document order, so what is below a node is an interval of ids. Counts and lengths are running sums over a
page (one cumulative column each): what a subtree holds is the difference of two of its places, so all elements of a page
cost as much as its nodes, however deep they are. Ancestors are found by a running maximum of where elements end, siblings
by windows over a parent's children. Everything is dealt once, by page, as narrow rows without texts; the windows, the
grouping and the ranking that follow share that one exchange. What one task sorts is bounded by dealing into more parts
(deals) the more markup there is.

The id columns tell pages apart; a page without nodes (null) gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pagelift.functions import matchers
from pagelift.functions import text as X
from pagelift.sources.html import ELEMENT, TEXT

from .clean import DATA_PARTS, EMBEDDED, HEADINGS
from .native import attribute, below, covered, fishy, table_kind, tagged, text_of

#: A run of spaces at the end, looked for only where it begins.
_TRAIL = f"(?<!{X.WIDE_CLASS}){X.WIDE_CLASS}++\\z"
#: The least and largest whole number of a span.
_LEAST, _MOST = -(2**63), 2**63 - 1
#: Bytes of markup whose nodes one task sorts, some 50,000 to 100,000 of them.
DEAL_BYTES = 2 << 20


def deals(pages: DataFrame, html_col: str = "html") -> int:
    """Parts to deal a table's nodes into, so that each holds those of some DEAL_BYTES of markup: it grows with the table."""
    size = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // DEAL_BYTES))


def node_rows(tables: DataFrame, id_cols: Sequence[str], nodes_col: str = "nodes") -> DataFrame:
    """id columns and the fields of each node of each page, one row a node."""
    return tables.select(*id_cols, F.explode(nodes_col).alias("n")).select(*id_cols, "n.*")


def _upto(id_cols: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*id_cols).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(id_cols: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*id_cols).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)


def _gathered(rows: DataFrame, id_cols: Sequence[str], columns: Sequence[str], **more: Column) -> DataFrame:
    """A row for each page with n, its nodes as structs of columns; the place of a node is its id."""
    return rows.groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("n"), *(c.alias(k) for k, c in more.items()))


def _held(x: Column, name: str) -> Column:
    """What is below a node, of a column of running sums."""
    return F.get(F.col("n"), x["last_id"])[name] - x[name]


def _sentences(nodes: Column) -> Column:
    """nodes with sentence: whether a paragraph's text has a sentence's end."""

    def ends(x: Column) -> Column:
        inner = F.array(X.inner_col(text_of(nodes, x)))
        return F.exists(inner, lambda t: F.contains(t, F.lit(". ")) | F.endswith(t, F.lit(".")))

    return F.transform(nodes, lambda x: x.withField("sentence", F.when((x["kind"] == ELEMENT) & (x["tag"] == "p"), ends(x)).otherwise(False)))


def _dealt(rows: DataFrame, id_cols: Sequence[str], parts: int | None) -> DataFrame:
    """rows dealt by page into parts (None: as the session's settings say, by what follows)."""
    return rows if parts is None else rows.repartition(parts, *id_cols)


def _text_rows(tables: DataFrame, id_cols: Sequence[str], nodes_col: str, more: dict[str, Column], parts: int | None) -> DataFrame:
    """Narrow node rows with more of their columns, with total: units up to each node's end in which each run of ASCII spaces, over the bounds of text
    nodes, too, counts one; and where the node's text without spaces at its ends begins and ends in it."""
    kind, tag, text, attrs = (F.col(c) for c in ("kind", "tag", "text", "attrs"))
    is_text, is_element = kind == TEXT, kind == ELEMENT
    some = is_text & (text != "")
    count = lambda c: F.when(some, c).otherwise(0)
    shows_video = F.exists(attrs, lambda a: a["val"].rlike(matchers.VIDEOS))
    spaced = f"^{X.WIDE_CLASS}|{X.WIDE_CLASS}\\z"
    names = {"class": attribute(attrs, "class"), "id_": attribute(attrs, "id"), "href": F.when(tag == "a", attribute(attrs, "href")).otherwise(""), "own_video": F.when(is_element, shows_video).otherwise(False)}
    rows = node_rows(tables, id_cols, nodes_col).select(*id_cols, "id", "parent", "depth", "last_id", "kind", "tag", "text", *(c.alias(k) for k, c in more.items()), *(F.when(is_element, c).otherwise(F.lit("") if k != "own_video" else False).alias(k) for k, c in names.items()))
    # What is used more than once stands in a row of its own, so that it is worked out once.
    rows = rows.withColumns({"flat": count(X.utf16_col(X.collapse_col(text))), "spaced": some & text.rlike(spaced)})
    edge = lambda pattern: F.when(F.col("spaced"), X.utf16_col(X.collapse_col(F.regexp_extract(text, pattern, 0)))).otherwise(0)
    rows = rows.select(
        *id_cols, "id", "parent", "depth", "last_id", "kind", "tag", "class", "flat", "own_video", *more,
        F.when((F.col("class") != "") | (F.col("id_") != ""), matchers.class_weight_col(F.col("class"), F.col("id_"))).otherwise(0).alias("weight"),
        F.when(some, F.col("spaced") & text.rlike(f"^{X.ASCII_CLASS}")).alias("opens"), F.when(some, F.col("spaced") & text.rlike(f"{X.ASCII_CLASS}\\z")).alias("closes"),
        (some & text.rlike(f"[^{X.WIDE_CLASS[1:]}")).alias("core"), edge(f"^{X.WIDE_CLASS}++").alias("lead"), edge(_TRAIL).alias("trail"),
        count(F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))).alias("commas"), count(X.commas_col(text)).alias("score_commas"),
        ((F.length("href") > 1) & F.col("href").startswith("#")).alias("anchored"),
        (F.col("own_video") | (F.contains(text, F.lit("//")) & text.rlike(matchers.VIDEOS))).cast("int").alias("any_video"),
    )
    rows = _dealt(rows, id_cols, parts)
    joint = F.coalesce(F.col("opens") & F.last("closes", ignorenulls=True).over(_before(id_cols)), F.lit(False)).cast("int")
    rows = rows.withColumn("joint", joint)
    rows = rows.withColumns({"total": F.sum(F.col("flat") - F.col("joint")).over(_upto(id_cols)), "cores": F.sum(F.col("core").cast("int")).over(_upto(id_cols)), "videos_upto": F.sum("any_video").over(_upto(id_cols))})
    return rows.withColumns({"first_at": F.col("total") - F.col("flat") + F.col("lead"), "end_at": F.col("total") - F.col("trail")})


def measured(tables: DataFrame, id_cols: Sequence[str], nodes_col: str = "nodes", siblings: bool = False, needed: Sequence[str] | None = None, parts: int | None = None, rules: bool = False) -> DataFrame:
    """A row for each page: id columns and n, its nodes with their length (units of inner text) and running sums of all
    that the conditional rules and the scores count, or of those needed. siblings: with the number of elements below a node's parent, and
    whether a paragraph has a sentence's end. rules: with is_data (of tables), in_data (lies in a table of data) and kin
    (most elements below one of the elements that share a node's parent). parts: see deals."""
    own = ["id", "parent", "depth", "last_id", "kind", "tag", "class", "weight"]
    more = {}
    if siblings:
        tables, more = tables.withColumn(nodes_col, _sentences(F.col(nodes_col))), {"sentence": F.col("sentence")}
    elif rules:
        more = _table_columns()
    rows = _text_rows(tables, id_cols, nodes_col, more, parts)
    beside = Window.partitionBy(*id_cols, "parent")
    if siblings or rules:
        rows = rows.withColumn("elements", F.sum(F.when(F.col("kind") == ELEMENT, 1).otherwise(0)).over(beside))
    if siblings:
        own += ["sentence", "elements"]
    at_first = []
    if rules:
        rows = rows.withColumns({to: F.sum(c).over(_upto(id_cols)) for c, to in _TABLE_SUMS.items()})
        at_first = ["elements", *_TABLE_MARKS, *_TABLE_SUMS.values()]
    # first_at lacks the space that the text before has counted already.
    core = F.when(F.col("core"), F.struct("id", F.col("first_at").alias("first"), F.col("end_at").alias("end")))
    pages = _gathered(rows, id_cols, [*own, "cores", "videos_upto", "commas", "score_commas", "anchored", "own_video", *at_first], c=F.array_sort(F.collect_list(core)))
    nodes, cores = F.col("n"), F.col("c")

    def with_length(x: Column, widths: Column | None = None) -> Column:
        last = F.get(nodes, x["last_id"])
        length = F.when((x["kind"] == ELEMENT) & (last["cores"] > x["cores"]), F.get(cores, (last["cores"] - 1).cast("int"))["end"] - F.get(cores, x["cores"].cast("int"))["first"]).otherwise(0)
        video = x["own_video"] | (x["tag"] == "object") & (last["videos_upto"] > x["videos_upto"])
        out = [*(x[c].alias(c) for c in own), x["commas"].alias("commas_"), x["score_commas"].alias("score_commas_"), x["anchored"].alias("anchored"), video.alias("video"), length.alias("length")]
        if widths is not None:
            is_data = F.when((x["kind"] == ELEMENT) & (x["tag"] == "table"), _table_size(x, widths)["is_data"]).otherwise(False)
            # The first node below an element stands behind it, and knows how many elements share its parent.
            held = F.when((x["kind"] == ELEMENT) & (x["last_id"] > x["id"]), F.get(nodes, x["id"] + 1)["elements"]).otherwise(0)
            out += [is_data.alias("is_data"), held.alias("held")]
        return F.struct(*out)

    each = X.let(_row_widths(), lambda widths: F.transform(nodes, lambda x: with_length(x, widths))) if rules else F.transform(nodes, lambda x: with_length(x))
    rows = pages.select(*id_cols, F.explode(each).alias("x")).select(*id_cols, "x.*")
    if rules:
        in_data = F.coalesce(F.max(F.when(F.col("is_data"), F.col("last_id"))).over(_before(id_cols)) >= F.col("id"), F.lit(False))
        rows = rows.withColumns({"in_data": in_data, "kin": F.max("held").over(beside)})
        own += ["is_data", "in_data", "kin"]
    is_element, tag, length = F.col("kind") == ELEMENT, F.col("tag"), F.col("length")
    one = lambda *tags: F.when(is_element & tag.isin(*tags), 1).otherwise(0)
    units = lambda *tags: F.when(is_element & tag.isin(*tags), length).otherwise(0)
    sums = {
        "paragraphs": one("p"), "images": one("img"), "items": one("li"), "inputs": one("input"), "embeds": one(*EMBEDDED), "commas": F.col("commas_"), "score_commas": F.col("score_commas_"),
        "heading_length": units(*HEADINGS), "list_length": units("ul", "ol"), "links": F.when(F.col("anchored"), 0).otherwise(units("a")), "anchors": F.when(F.col("anchored"), length).otherwise(0),
        "videos": F.when(is_element & tag.isin(*EMBEDDED) & F.col("video"), 1).otherwise(0),
    }
    sums = {k: c for k, c in sums.items() if needed is None or k in needed}
    rows = rows.withColumns({k: F.sum(c).over(_upto(id_cols)) for k, c in sums.items()})
    return _gathered(rows, id_cols, [*own, "length", *sums])


def _link_length(x: Column) -> Column:
    return _held(x, "links") + _held(x, "anchors") * 0.3


def _density(x: Column) -> Column:
    return F.coalesce(F.try_divide(_link_length(x), x["length"].cast("double")), F.lit(0.0))


def subtree_stats(tables: DataFrame, id_cols: Sequence[str], tags: Sequence[str] = ("div", "ul", "nav", "article"), nodes_col: str = "nodes", parts: int | None = None) -> DataFrame:
    """What each element of the tags holds below it: counts of elements, of ASCII commas, units of its inner text and of
    those of its headings, lists and links (links within the page count 0.3), and whether a known video is embedded."""
    found = F.transform(F.filter("n", lambda x: (x["kind"] == ELEMENT) & x["tag"].isin(*tags)), lambda x: F.struct(*_stats(x)))
    return measured(tables, id_cols, nodes_col, parts=parts).select(*id_cols, F.explode(found).alias("s")).select(*id_cols, "s.*")


def _stats(x: Column) -> list[Column]:
    return [
        x["id"].alias("id"), x["tag"].alias("tag"), *(_held(x, c).alias(c) for c in ("paragraphs", "images", "items", "inputs", "embeds", "commas")), x["length"].cast("long").alias("length"), _held(x, "heading_length").alias("heading_length"),
        _held(x, "list_length").alias("list_length"), _link_length(x).alias("link_length"), (_held(x, "videos") > 0).alias("video"), x["weight"].alias("weight"), x["depth"].alias("depth"),
    ]


#: The sums that scores are made of.
_SCORED_BY = ("score_commas", "links", "anchors")


def _start(x: Column) -> Column:
    """The points that an element begins with, by its tag and names."""
    from .article import POINTS

    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in POINTS.items() for v in pair]), x["tag"]), F.lit(0.0)) + x["weight"]


def content_scores(tables: DataFrame, id_cols: Sequence[str], nodes_col: str = "nodes", parts: int | None = None) -> DataFrame:
    """Scores of the ancestors of the paragraphs of a node table as it is: id columns, id, last_id, tag, class, score, and
    met, the order in which they are met from paragraph to paragraph, each time from the nearest on.

    Each scored element gives its points to up to five ancestors, divided by 1, 2, 6, 9 and 12; an ancestor begins
    with the points of its tag and names, and its score falls with its share of links.
    """
    return _scores(measured(tables, id_cols, nodes_col, needed=_SCORED_BY, parts=parts), id_cols)


def top_candidates(scores: DataFrame, id_cols: Sequence[str], count: int = 5) -> DataFrame:
    """The best candidates of each page; of equal ones those met first."""
    rank = F.row_number().over(Window.partitionBy(*id_cols).orderBy(F.desc("score"), "met"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= count)


def _points_given() -> Column:
    """What the scored elements of a page give to their ancestors: an array of _GIVEN."""
    from .article import ANCESTORS, LEAST_PARAGRAPH, SCORED

    nodes = F.col("n")

    def given(x: Column) -> Column:
        points = (2 + _held(x, "score_commas") + F.least(F.floor(x["length"] / 100), F.lit(3))).cast("double")
        up, out = F.get(nodes, x["parent"]), []
        for level in range(ANCESTORS):
            counts = (up["kind"] == ELEMENT) & (F.get(nodes, up["parent"])["kind"] == ELEMENT)
            values = [*(up[c] for c in ("id", "last_id", "tag", "class")), _start(up), _density(up), points / (1, 2, 6, 9, 12)[level], x["id"].cast("long") * 8 + level]
            out.append(F.when(counts, F.struct(*(v.cast(kind).alias(k) for v, (k, kind) in zip(values, _GIVEN.items(), strict=True)))))
            up = F.get(nodes, up["parent"])
        return F.array(*out)

    scored = F.filter(nodes, lambda x: (x["kind"] == ELEMENT) & x["tag"].isin(*sorted(SCORED)) & (x["length"] >= LEAST_PARAGRAPH))
    return F.filter(F.flatten(F.transform(scored, given)), lambda g: g.isNotNull())


_GIVEN = {"id": "int", "last_id": "int", "tag": "string", "class": "string", "start": "double", "density": "double", "points": "double", "met": "long"}


def _summed(rows: DataFrame, id_cols: Sequence[str], *more: Column) -> DataFrame:
    sums = rows.groupBy(*id_cols, "id").agg(*(F.max(c).alias(c) for c in ("last_id", "tag", "class", "start", "density")), F.sum("points").alias("points"), F.min("met").alias("met"), *more)
    return sums.withColumn("score", (F.col("start") + F.col("points")) * (1 - F.col("density")))


def _scores(pages: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    rows = pages.select(*id_cols, F.explode(_points_given()).alias("g")).select(*id_cols, "g.*")
    return _summed(rows, id_cols).select(*id_cols, "id", "last_id", "tag", "class", "met", "score")


def _with_scores(pages: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """pages with s, the candidates from best to worst. A page's nodes go along in a row beside what is given, so that pages
    are neither parsed twice nor joined."""
    own = F.struct(*(F.lit(-1 if k == "id" else None).cast(kind).alias(k) for k, kind in _GIVEN.items()), F.col("n").alias("n"))
    given = F.transform(_points_given(), lambda g: F.struct(*(g[k].alias(k) for k in _GIVEN), F.when(F.lit(False), F.col("n")).alias("n")))
    rows = pages.select(*id_cols, F.explode(F.concat(F.array(own), given)).alias("g")).select(*id_cols, "g.*")
    rows = _summed(rows, id_cols, F.first("n", ignorenulls=True).alias("n"))
    candidate = F.when(F.col("id") >= 0, F.struct((-F.col("score")).alias("minus"), "met", "id", "last_id", "tag"))
    return rows.groupBy(*id_cols).agg(F.first("n", ignorenulls=True).alias("n"), F.array_sort(F.collect_list(candidate)).alias("s"))


# The top candidate and its siblings


def chosen_tops(tables: DataFrame, id_cols: Sequence[str], count: int = 5, nodes_col: str = "nodes", parts: int | None = None) -> DataFrame:
    """The element that each page's article grows from: id, parent, tag, class and score (id is null where there is no
    candidate or the best is the body, for which an element is made).

    Of the best candidates (equal ones: the first met) the first; if three others have three quarters of its score, the
    nearest element around it that holds three of them; then up to the first element whose score is larger than the one
    before, while scores stay above a third; then up over parents without another element.
    """
    pages = measured(tables, id_cols, nodes_col, siblings=True, needed=_SCORED_BY, parts=parts)
    return _chosen(pages, id_cols, count).select(*id_cols, "at.*")


def _chosen(pages: DataFrame, id_cols: Sequence[str], count: int) -> DataFrame:
    """A row for each page: id columns, n, s (see _with_scores), and at, the chosen element."""
    from .article import CLOSE, CLOSE_COUNT

    n, s = F.col("n"), F.col("s")
    around = lambda a, x: (a["id"] < x["id"]) & (x["id"] <= a["last_id"])
    score_of = lambda x: F.coalesce(-F.get(F.filter(s, lambda c: c["id"] == x["id"]), F.lit(0))["minus"], _start(x))

    def above(places: Column, x: Column, stop: Column) -> Column:
        """Elements around x, below the body, from the nearest on."""
        return F.reverse(F.filter(places, lambda a: around(a, x) & (a["id"] > stop)))

    def shared(best: Column, stop: Column) -> Column:
        """Id of the best, or of the nearest element around it that holds enough of those close to it."""
        close = F.filter(F.slice(s, 2, count - 1), lambda x: (best["minus"] != 0) & (x["minus"] / best["minus"] >= CLOSE))
        found = lambda own: F.filter(above(n, best, stop), lambda a: F.size(F.filter(own, lambda c: around(a, c))) >= CLOSE_COUNT)
        return X.let(close, lambda own: F.when(F.size(own) >= CLOSE_COUNT, F.coalesce(F.get(found(own), F.lit(0))["id"], best["id"])).otherwise(best["id"]))

    def climbed(at: Column, score: Column, stop: Column) -> Column:
        """Id of the first scored element above whose score is larger than the one before."""

        def step(state: Column, a: Column) -> Column:
            low, higher = -a["minus"] < score / 3, -a["minus"] > state["last"]
            new = F.struct(F.when(~low & higher, a["id"]).otherwise(state["id"]).alias("id"), (-a["minus"]).alias("last"), (low | higher).alias("done"))
            return F.when(state["done"], state).otherwise(new)

        scored = F.sort_array(F.transform(F.filter(s, lambda a: around(a, at) & (a["id"] > stop)), lambda a: F.struct(a["id"].alias("id"), a["minus"].alias("minus"))), asc=False)
        return F.aggregate(scored, F.struct(at["id"].alias("id"), score.alias("last"), F.lit(False).alias("done")), step, lambda x: x["id"])

    def alone(at: Column, stop: Column) -> Column:
        """Id of the last element above of which each is the only one below the next."""
        step = lambda state, a: F.when(state["elements"] == 1, F.struct(a["id"].alias("id"), a["elements"].alias("elements"))).otherwise(state)
        return F.aggregate(above(n, at, stop), F.struct(at["id"].alias("id"), at["elements"].alias("elements")), step, lambda x: x["id"])

    def chosen(best: Column) -> Column:
        body = F.get(F.filter(n, lambda x: (x["kind"] == ELEMENT) & (x["tag"] == "body")), F.lit(0))
        stop = X.let(body, lambda b: F.coalesce(F.when(around(b, best), b["id"]), F.lit(0)))
        fields = lambda at: F.struct(*(at[c].alias(c) for c in ("id", "parent", "tag", "class")), score_of(at).alias("score"))

        def from_there(stop: Column) -> Column:
            first = lambda at: X.let(score_of(at), lambda score: F.get(n, climbed(at, score, stop)))
            return X.let(F.get(n, shared(best, stop)), lambda at: X.let(first(at), lambda up: X.let(F.get(n, alone(up, stop)), fields)))

        return X.let(stop, from_there)

    best = F.get(s, F.lit(0))
    return _with_scores(pages, id_cols).select(*id_cols, "n", "s", F.when(best["tag"] != "body", X.let(best, chosen)).alias("at"))


def joined_siblings(tables: DataFrame, id_cols: Sequence[str], count: int = 5, nodes_col: str = "nodes", parts: int | None = None) -> DataFrame:
    """The elements beside each page's chosen one, and why they join the article (reason is null if they don't): it is the
    top itself, its score (with a bonus for the class of the top) is a fifth of the top's and at least 10, or it is a
    paragraph that is long and has few links, or short, without links and with a sentence's end.

    Siblings and scores of a page stand in rows of one id, and are grouped, so that pages are neither parsed twice nor joined.
    """
    pages = _chosen(measured(tables, id_cols, nodes_col, siblings=True, needed=_SCORED_BY, parts=parts), id_cols, count).filter("at.id is not null")
    kinds = {"tag": "string", "class": "string", "sentence": "boolean", "length": "long", "density": "double"}
    sibling = lambda x: F.struct(x["id"].alias("id"), F.lit(None).cast("double").alias("score"), *((_density(x) if k == "density" else x[k]).cast(kind).alias(k) for k, kind in kinds.items()))
    scored = F.transform("s", lambda x: F.struct(x["id"].alias("id"), (-x["minus"]).alias("score"), *(F.lit(None).cast(kind).alias(k) for k, kind in kinds.items())))
    beside = F.transform(F.filter("n", lambda x: (x["kind"] == ELEMENT) & (x["parent"] == F.col("at.parent"))), sibling)
    rows = pages.select(*id_cols, *(F.col(f"at.{c}").alias(k) for c, k in (("id", "top"), ("class", "top_class"), ("score", "top_score"))), F.explode(F.concat(beside, scored)).alias("x"))
    rows = rows.select(*id_cols, "top", "top_class", "top_score", "x.*").groupBy(*id_cols, "id").agg(*(F.max(c).alias(c) for c in ("top", "top_class", "top_score", "score", *kinds))).filter("tag is not null")
    bonus = F.when((F.col("top_class") != "") & (F.col("class") == F.col("top_class")), F.col("top_score") * 0.2).otherwise(0.0)
    by_score = F.col("score") + bonus >= F.greatest(F.lit(10.0), F.col("top_score") * 0.2)
    is_p, length = F.col("tag") == "p", F.col("length")
    reason = F.when(F.col("id") == F.col("top"), "top").when(by_score, "score").when(is_p & (length > 80) & (F.col("density") < 0.25), "long").when(is_p & (length < 80) & (F.col("density") == 0) & F.col("sentence"), "short")
    return rows.select(*id_cols, "id", "tag", reason.alias("reason"))


# Ancestors


def ancestor_tests(tables: DataFrame, id_cols: Sequence[str], tests: dict[str, tuple[str, int, Callable[[Column], Column] | None]], tags: Sequence[str] | None = None, nodes_col: str = "nodes", parts: int | None = None) -> DataFrame:
    """For each element (of tags), whether an ancestor has a tag: a column for each of tests.

    A test is a tag, a depth and a condition on the ancestor (a function of its struct, or None). A depth up to 0 is none;
    beyond, the depth is looked at before the ancestor is: a depth of 3 sees four ancestors. An element lies in another if
    that begins before it and ends no earlier, and as elements are nested, that holds for some element of a tag exactly if
    the largest end among those before does: a running maximum, without a join. A bounded depth follows parents.
    """
    nodes = F.col(nodes_col)
    meets = lambda x, tag, ok: (x["kind"] == ELEMENT) & (x["tag"] == tag) & (F.lit(True) if ok is None else ok(x))

    def near(x: Column) -> Column:
        out = [x[c].alias(c) for c in ("id", "last_id", "kind", "tag")]
        for name, (tag, depth, ok) in tests.items():
            if depth <= 0:
                out.append(F.coalesce(meets(x, tag, ok), F.lit(False)).alias(name))
                continue
            up, found = x, F.lit(False)
            for _ in range(depth + 1):
                up = F.get(nodes, up["parent"])
                found = found | F.coalesce(meets(up, tag, ok), F.lit(False))
            out.append(found.alias(name))
        return F.struct(*out)

    rows = _dealt(tables.select(*id_cols, F.explode(F.transform(nodes, near)).alias("x")).select(*id_cols, "x.*"), id_cols, parts)
    ends = {k: F.coalesce(F.max(F.when(F.col(k), F.col("last_id"))).over(_before(id_cols)) >= F.col("id"), F.lit(False)) for k, t in tests.items() if t[1] <= 0}
    rows = rows.withColumns(ends) if ends else rows
    return rows.filter((F.col("kind") == ELEMENT) & (F.lit(True) if tags is None else F.col("tag").isin(*tags))).select(*id_cols, "id", "tag", *tests)


# Tables


def span(value: Column) -> Column:
    """A row's or column's span: a whole number with an optional sign, kept within 64 bits; what is none, and 0, is 1."""
    digits = F.concat(F.regexp_extract(value, "^-?", 0), F.substring(F.regexp_replace(value, "^[+-]?0*", ""), 1, 20))  # 20 digits are beyond 64 bits, whatever follows
    whole = F.when(value.rlike(r"^[+-]?[0-9]+\z"), F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))
    kept = F.least(F.greatest(whole, F.lit(_LEAST).cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)"))
    return F.when(whole.isNotNull() & (kept != 0), kept).otherwise(F.lit(1).cast("decimal(38,0)"))


#: Attributes of tables, and the running sums that their sizes are made of.
_TABLE_MARKS = ("role", "datatable", "summary")
_TABLE_SUMS = {"rows_": "n_rows", "cells_": "cells", "tr_": "trs", "nested_": "nested", "captions_": "captions", "parts_": "parts"}


def _table_columns() -> dict[str, Column]:
    """What a node row adds to the sums, and a table's attributes."""
    tag, attrs, is_element = F.col("tag"), F.col("attrs"), F.col("kind") == ELEMENT
    zero = F.lit(0).cast("decimal(38,0)")
    return {
        "rows_": F.when(is_element & (tag == "tr"), span(attribute(attrs, "rowspan"))).otherwise(zero), "cells_": F.when(is_element & (tag == "td"), span(attribute(attrs, "colspan"))).otherwise(zero),
        "tr_": (is_element & (tag == "tr")).cast("int"), "nested_": (is_element & (tag == "table")).cast("int"),
        "captions_": (is_element & ((tag == "caption") & (F.col("last_id") > F.col("id")))).cast("int"), "parts_": (is_element & tag.isin(*DATA_PARTS)).cast("int"),
        **{a: F.when(is_element & (tag == "table"), attribute(attrs, a)) for a in _TABLE_MARKS},
    }


def _row_widths() -> Column:
    """Spans of the cells of each of a page's rows."""
    return F.transform(F.filter("n", lambda x: (x["kind"] == ELEMENT) & (x["tag"] == "tr")), lambda x: _held(x, "cells"))


def _table_size(x: Column, widths: Column) -> Column:
    zero = F.lit(0).cast("decimal(38,0)")
    own = F.slice(widths, (x["trs"] + 1).cast("int"), _held(x, "trs").cast("int"))
    columns = F.greatest(F.coalesce(F.array_max(own), zero), zero)
    return F.struct(x["id"].alias("id"), _held(x, "n_rows").alias("n_rows"), columns.alias("n_columns"), table_kind(x["role"], x["datatable"], x["summary"], _held(x, "captions") > 0, _held(x, "parts") > 0, _held(x, "nested") > 0, _held(x, "n_rows"), columns).alias("is_data"))


def table_sizes(tables: DataFrame, id_cols: Sequence[str], nodes_col: str = "nodes", parts: int | None = None) -> DataFrame:
    """Each table's rows (sum of its rows' spans) and columns (the largest sum of a row's cells' spans), with those of
    tables inside, and is_data: whether it holds data rather than layout.

    Spans are running sums over the page; the rows of a table are a segment of the page's rows.
    """
    rows = _dealt(node_rows(tables, id_cols, nodes_col).select(*id_cols, "id", "last_id", "kind", "tag", *(c.alias(k) for k, c in _table_columns().items())), id_cols, parts)
    rows = rows.withColumns({to: F.sum(c).over(_upto(id_cols)) for c, to in _TABLE_SUMS.items()})
    pages = _gathered(rows, id_cols, ["id", "last_id", "kind", "tag", *_TABLE_MARKS, *_TABLE_SUMS.values()])
    found = X.let(_row_widths(), lambda widths: F.transform(F.filter("n", lambda x: (x["kind"] == ELEMENT) & (x["tag"] == "table")), lambda x: _table_size(x, widths)))
    return pages.select(*id_cols, F.explode(found).alias("s")).select(*id_cols, "s.*")


# Rows of breaks


def is_phrasing(nodes: Column, x: Column) -> Column:
    """Text, an element of phrasing content, or a link, deletion or insertion without anything else below it."""
    from .dom import PHRASING

    transparent = lambda y: (y["kind"] == ELEMENT) & y["tag"].isin("a", "del", "ins")
    plain = lambda y: (y["kind"] == ELEMENT) & y["tag"].isin(*sorted(PHRASING))

    def step(s: Column, y: Column) -> Column:
        other = F.when(plain(y), F.struct(y["last_id"].alias("over"), s["bad"].alias("bad"))).when(transparent(y), s).otherwise(F.struct(s["over"].alias("over"), F.lit(True).alias("bad")))
        return F.when((y["id"] <= s["over"]) | (y["kind"] == TEXT), s).otherwise(other)

    start = F.struct(F.lit(-1).alias("over"), F.lit(False).alias("bad"))
    return F.when(transparent(x), ~F.aggregate(below(nodes, x), start, step, lambda s: s["bad"])).otherwise((x["kind"] == TEXT) | plain(x))


def break_chains(tables: DataFrame, id_cols: Sequence[str], nodes_col: str = "nodes", parts: int | None = None) -> DataFrame:
    """Rows of two or more breaks that begin a paragraph: parent, id and place of the first, length (breaks in the row),
    and n_nodes: the nodes after it that the paragraph takes, up to the next such row or what is no phrasing content,
    without blank ones and breaks at the end.

    Breaks with nothing but blanks between them are an island. From its first on a row takes the next break and those that
    follow it at once; where a blank parts them the next row begins, so that of the parted ones every other is a beginning.
    A last one alone is no row. All are windows over the children of a parent.
    """
    nodes, text = F.col(nodes_col), F.col("text")
    rows = node_rows(tables.withColumn(nodes_col, F.transform(nodes, lambda x: x.withField("phrasing", is_phrasing(nodes, x)))), id_cols, nodes_col)
    br = (F.col("kind") == ELEMENT) & (F.col("tag") == "br")
    solid = (F.col("kind") == ELEMENT) | ((F.col("kind") == TEXT) & text.rlike("[^ \\t\\n\\r\\f]"))
    empty = br | ((F.col("kind") == TEXT) & ~text.rlike(f"[^{X.WIDE_CLASS[1:]}"))
    rows = rows.select(*id_cols, "parent", "id", "pos", "phrasing", br.alias("br"), F.when(solid, br).alias("solid_br"), empty.alias("empty"))
    rows = _dealt(rows, id_cols, parts)
    within = Window.partitionBy(*id_cols, "parent").orderBy("pos")
    upto, before = (within.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    after = Window.partitionBy(*id_cols, "parent").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda w: F.col("br") & F.coalesce(F.last("solid_br", ignorenulls=True).over(w), F.lit(False))
    rows = rows.withColumns({"follows": near(before), "goes_on": near(after), "touches": F.col("br") & F.coalesce(F.lag("br").over(within), F.lit(False))})
    parted = F.col("br") & (~F.col("follows") | ~F.col("touches"))
    rows = rows.withColumns({"parted": parted, "run": F.sum((F.col("br") & (~parted | ~F.col("follows"))).cast("int")).over(upto)})
    order = Window.partitionBy(*id_cols, "parent", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = F.col("parted") & (F.sum(F.col("parted").cast("int")).over(order) % 2 == 1)
    rows = rows.withColumn("odd", odd).withColumns({"starts": F.col("odd") & F.col("goes_on"), "member": F.col("br") & ~(F.col("odd") & ~F.col("goes_on"))})
    rows = rows.withColumn("chain", F.sum(F.col("starts").cast("int")).over(upto)).filter("chain > 0")
    own = Window.partitionBy(*id_cols, "parent", "chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("taken", ~F.col("member") & (F.sum((~F.col("phrasing")).cast("int")).over(own) == 0))
    rows = rows.withColumn("at", F.sum(F.col("taken").cast("int")).over(own))
    found = rows.groupBy(*id_cols, "parent", "chain").agg(F.min("id").alias("id"), F.min("pos").alias("place"), F.sum(F.col("member").cast("int")).alias("length"), F.coalesce(F.max(F.when(F.col("taken") & ~F.col("empty"), F.col("at"))), F.lit(0)).alias("n_nodes"))
    return found.drop("chain")


# Texts


def normalized_text(nodes: Column) -> Column:
    """All text of a page: runs of spaces as one, none at the ends; text below pre and textarea as it is. Where such a text
    begins or ends with a space, that one parts it from what stands beside it.

    Each piece looks at the one before it that is no blank, so no text is built up step by step.
    """
    texts = F.transform(F.filter(nodes, lambda x: (x["kind"] == TEXT) & (x["text"] != "")), lambda x: x["id"])
    kept = F.array_intersect(texts, covered(nodes, "pre", "textarea"))
    marked = lambda ids, flag: F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(flag).alias("verbatim")))
    order = F.array_sort(F.concat(marked(F.array_except(texts, kept), False), marked(kept, True)))
    space = X.WIDE_CLASS

    def piece(x: Column, at: Column) -> Column:
        text = F.get(nodes, x["id"])["text"]
        own = F.when(x["verbatim"], text).otherwise(X.plain_col(text))
        return F.struct(at.alias("at"), x["verbatim"].alias("verbatim"), own.alias("own"), text.rlike(f"^{space}").alias("opens"), text.rlike(f"{space}\\z").alias("closes"))

    solid = F.filter(F.transform(order, piece), lambda p: p["own"] != "")

    def joined(all_: Column) -> Column:
        def spaced(p: Column, i: Column) -> Column:
            last = F.get(all_, i - 1)
            waiting = (~last["verbatim"] & last["closes"]) | (p["at"] - last["at"] > 1) | (~p["verbatim"] & p["opens"])
            apart = (i > 0) & waiting & ~(last["verbatim"] & last["closes"]) & ~(p["verbatim"] & p["opens"])
            return F.concat(F.when(apart, " ").otherwise(""), p["own"])

        return F.array_join(F.transform(all_, spaced), "")

    # The pieces stand in an array of one, so that they are worked out once and not for each of them.
    return F.coalesce(F.get(F.transform(F.array(solid), joined), F.lit(0)), F.lit(""))


# JSON-LD

#: Arrays within arrays of contexts and types that are looked into.
_NESTED = 4


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _get(v: Column, key: str) -> Column:
    """A member of an object; null if there is none."""
    return F.try_variant_get(v, f"$['{key}']", "variant")


def _string(v: Column) -> Column:
    """A string's value; null for everything else, numbers included."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _items(v: Column) -> Column:
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def _flat(v: Column) -> Column:
    """A value, or what its arrays hold, in order."""
    out = F.array(v)
    for _ in range(_NESTED):
        out = F.flatten(F.transform(out, lambda x: F.coalesce(_items(x), F.array(x))))
    return out


def _value(v: Column, key: str) -> Column:
    return F.coalesce(X.trim_col(_string(_get(v, key))), F.lit(""))


def json_ld(sources: Column, title: Column) -> Column:
    """title, byline, excerpt, site_name and published_time of the first article in the JSON-LD of a page's scripts (an
    array of their contents), null if there is none; title: the page's, which tells name and headline apart.

    Roots, or the members of their arrays, count if their context leaves the schema.org vocabulary: later contexts go
    over earlier ones. Each root is followed by the members of its graph. An object that has a key twice is not read, unless
    the session sets spark.sql.variant.allowDuplicateKeys (then the last counts).
    """
    schema = matchers.SCHEMA.replace(r"\Z", r"\z")

    def vocabulary(before: Column, c: Column) -> Column:
        own, kind = _get(c, "@vocab"), _kind(c)
        named = F.when(own.isNull(), before).otherwise(F.coalesce(_string(own), F.lit("")))
        return F.when((kind == "STRING") & F.coalesce(_string(c).rlike(schema), F.lit(False)), _string(c)).when(kind == "OBJECT", named).otherwise(before)

    def counts(root: Column) -> Column:
        context = _get(root, "@context")
        left = F.aggregate(F.filter(_flat(context), lambda c: c.isNotNull()), F.lit(""), vocabulary)
        return (_kind(root) == "OBJECT") & left.rlike(schema)

    def is_article(v: Column) -> Column:
        types = F.transform(_flat(_get(v, "@type")), lambda t: F.regexp_replace(_string(t), "^https?://schema\\.org/", ""))
        return (_kind(v) == "OBJECT") & F.coalesce(F.exists(types, lambda t: F.coalesce(t.isin(*matchers.ARTICLE_TYPES), F.lit(False))), F.lit(False))

    def articles(source: Column) -> Column:
        text = F.regexp_replace(source, "^[ \\t\\n\\r\\f]*<!\\[CDATA\\[|\\]\\]>[ \\t\\n\\r\\f]*\\z", "")
        # What stands behind a value is passed over by the parser, so the value is set between brackets, of both kinds.
        alone = _items(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
        whole = X.let(alone, lambda a: F.when((F.size(a) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(), F.get(a, F.lit(0))))
        roots = F.filter(X.let(whole, lambda v: F.coalesce(_items(v), F.array(v))), lambda r: F.coalesce(counts(r), F.lit(False)))
        own = F.flatten(F.transform(roots, lambda r: F.concat(F.array(r), F.coalesce(_items(_get(r, "@graph")), F.array().cast("array<variant>")))))
        return F.filter(own, is_article)

    def fields(v: Column) -> Column:
        name, headline = (F.coalesce(_string(_get(v, k)), F.lit("")) for k in ("name", "headline"))
        like = lambda x: F.coalesce(X.similarity_col(x, title), F.lit(-1.0))
        both = (name != "") & (headline != "") & (name != headline)
        chosen = F.when(both & (like(headline) > 0.75) & (like(name) <= 0.75), headline).when(name != "", name).otherwise(headline)
        author = _get(v, "author")
        names = F.filter(F.transform(_items(author), lambda a: F.when(_kind(a) == "OBJECT", _value(a, "name"))), lambda n: F.coalesce(n != "", F.lit(False)))
        byline = F.when(_kind(author) == "STRING", X.trim_col(_string(author))).when(_kind(author) == "OBJECT", _value(author, "name")).when(_kind(author) == "ARRAY", F.array_join(names, ", "))
        publisher = _get(v, "publisher")
        site = F.when(_kind(publisher) == "OBJECT", _value(publisher, "name"))
        return F.struct(X.trim_col(chosen).alias("title"), F.coalesce(byline, F.lit("")).alias("byline"), _value(v, "description").alias("excerpt"), F.coalesce(site, F.lit("")).alias("site_name"), _value(v, "datePublished").alias("published_time"))

    first = F.slice(F.flatten(F.transform(sources, articles)), 1, 1)
    return F.get(F.transform(first, fields), F.lit(0))


def ld_scripts(nodes: Column) -> Column:
    """Contents of a page's JSON-LD scripts."""
    found = F.filter(tagged(nodes, "script"), lambda x: attribute(x["attrs"], "type") == "application/ld+json")
    return F.transform(found, lambda x: text_of(nodes, x))


# The conditional rules


def conditional_removals(tables: DataFrame, id_cols: Sequence[str], tags: Sequence[str] = ("form", "fieldset", "table", "ul", "div"), modifier: float = 0.0, nodes_col: str = "nodes", parts: int | None = None) -> DataFrame:
    """Which elements of the tags the conditional rules take out of a tree as it is: id columns, id, tag and goes.

    Tables of data, what lies in them and what lies near code stay; then the rules over what an element holds; a list whose
    items hold no more than one element stays if each has an image. All of it is read from one pass over the pages' nodes,
    without a join.
    """
    nodes = F.col("n")

    def near(x: Column, tag: str) -> Column:
        up, found = x, F.lit(False)
        for _ in range(4):
            up = F.get(nodes, up["parent"])
            found = found | F.coalesce((up["kind"] == ELEMENT) & (up["tag"] == tag), F.lit(False))
        return found

    def judged_by(x: Column) -> Column:
        wide = F.coalesce((x["last_id"] > x["id"]) & (F.get(nodes, x["id"] + 1)["kin"] > 1), F.lit(False))
        return F.struct(*_stats(x), near(x, "figure").alias("in_figure"), near(x, "code").alias("in_code"), x["is_data"].alias("is_data"), x["in_data"].alias("in_data"), wide.alias("wide"))

    found = F.transform(F.filter("n", lambda x: (x["kind"] == ELEMENT) & x["tag"].isin(*tags)), judged_by)
    rows = measured(tables, id_cols, nodes_col, parts=parts, rules=True).select(*id_cols, F.explode(found).alias("s")).select(*id_cols, "s.*")
    h = {c: F.col(c) for c in rows.columns} | {"link_density": F.coalesce(F.try_divide(F.col("link_length"), F.col("length").cast("double")), F.lit(0.0))}
    is_list = F.col("tag").isin("ul", "ol") | (F.coalesce(F.try_divide(F.col("list_length").cast("double"), F.col("length").cast("double")), F.lit(0.0)) > 0.9)
    judged = fishy(F.col("tag"), F.col("weight"), h, modifier)
    simple = is_list & (F.col("weight") >= 0) & ~F.col("wide") & (F.col("images") == F.col("items"))
    goes = F.when(F.col("is_data") | F.col("in_data") | F.col("in_code"), False).otherwise(judged & ~simple)
    return rows.select(*id_cols, "id", "tag", goes.alias("goes"))


# Links


def absolute_links(tables: DataFrame, id_cols: Sequence[str], url_col: str = "url", nodes_col: str = "nodes") -> DataFrame:
    """Absolute URLs of href of links (but to scripts), and of src, poster and each candidate of srcset of media: id columns,
    id, name, place (of the URL in the attribute), value, and behind (what stands behind it: size and comma, or '').

    Map-only: a page's base is found in its own row. Each step is a column of its own, so that expressions stay short.
    """
    from pagelift.functions import links

    nodes = F.col(nodes_col)
    href = F.transform(F.slice(tagged(nodes, "base"), 1, 1), lambda b: attribute(b["attrs"], "href"))
    rows = tables.withColumns({"page_": F.coalesce(F.col(url_col).cast("string"), F.lit("")), "href_": F.coalesce(F.get(href, F.lit(0)), F.lit(""))})
    rows = rows.withColumns({"from_": links.parsed(F.col("page_")), "to_": links.parsed(F.col("href_"))})
    rows = rows.withColumn("resolved_", links.resolved(F.col("from_"), F.col("to_"))).withColumn("written_", links.written(F.col("resolved_")))
    rows = rows.withColumn("base_", F.when((F.col("href_") != "") & F.col("from_.ok") & F.col("to_.ok"), F.col("written_")).otherwise(F.col("page_")))
    rows = rows.withColumn("from_", links.parsed(F.col("base_")))
    media = ["img", "picture", "figure", "video", "audio", "source"]
    kept = F.filter(nodes, lambda x: (x["kind"] == ELEMENT) & x["tag"].isin("a", *media))
    rows = rows.select(*id_cols, "page_", "base_", "from_", F.explode(kept).alias("x"))
    value = lambda name: attribute(F.col("x.attrs"), name)
    own = F.when(F.col("x.tag") == "a", F.array(F.struct(F.lit("href").alias("name"), value("href").alias("text")))).otherwise(F.array(*(F.struct(F.lit(k).alias("name"), value(k).alias("text")) for k in ("src", "poster", "srcset"))))
    rows = rows.select(*id_cols, "page_", "base_", "from_", F.col("x.id").alias("id"), F.explode(F.filter(own, lambda a: a["text"] != "")).alias("a")).select(*id_cols, "page_", "base_", "from_", "id", "a.*")
    rows = rows.filter((F.col("name") != "href") | ~links.javascript(F.col("text")))
    url, size, behind = (F.regexp_extract_all("text", F.lit(links.SRCSET), F.lit(k)) for k in (1, 2, 3))
    is_set = F.col("name") == "srcset"
    urls = F.when(is_set, url).when(F.col("name") == "href", F.split("text", ",%20", -1)).otherwise(F.array("text"))
    rows = rows.withColumn("behind_", F.when(is_set, F.zip_with(size, behind, lambda a, b: F.concat(a, b))))
    rows = rows.select(*id_cols, "page_", "base_", "from_", "id", "name", "behind_", F.posexplode(urls).alias("place", "uri_")).withColumn("uri_", X.trim_col(F.col("uri_")))
    rows = rows.withColumn("to_", links.parsed(F.col("uri_"))).withColumn("resolved_", links.resolved(F.col("from_"), F.col("to_"))).withColumn("written_", links.written(F.col("resolved_")))
    uri, made = F.col("uri_"), F.col("written_")
    stays = (uri == "") | ((F.col("base_") == F.col("page_")) & uri.startswith("#")) | ~F.col("from_.ok") | ~F.col("to_.ok")
    made = F.when(stays, uri).when(uri.endswith("#") & ~made.endswith("#"), F.concat(made, F.lit("#"))).otherwise(made)
    return rows.select(*id_cols, "id", "name", "place", made.alias("value"), F.coalesce(F.get("behind_", F.col("place")), F.lit("")).alias("behind"))
