"""Queries over whole trees, and their SQL.

Besides `pages` they read pages that are built from `part`, eight parts a page, with the lists, tables, figures, embedded
objects and nesting that `pages` lacks; their SQL works on the parts, not on markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelift.operators import native, trees
from pagelift.plans.kernel import node_table
from pagelift.plans.register import register

PER_PAGE = 8
#: Values of span attributes, and what they count; of class attributes, and what they weigh.
SPANS = {"": 1, "2": 2, "0": 1, "x": 1, "+3": 3, "-1": -1, " 4": 1, "12": 12}
CLASSES = {"part": 0, "content": 25, "sidebar": -25, "content sidebar": 0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages; fewer partitions than cores (one small file) are dealt anew, as parsing is what takes time."""
    out = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores, "page_id") if out.rdd.getNumPartitions() < cores else out


def built(spark: SparkSession, sf_dir: str, section: Column, before: Column | str, after: str) -> DataFrame:
    """Pages of PER_PAGE parts each: page_id, html; section: a part's markup."""
    parts = _table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {PER_PAGE}").alias("page_id"), F.col("p_partkey").alias("k"), section.alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), "")
    return parts.groupBy("page_id").agg(F.concat(F.lit(before) if isinstance(before, str) else before, body, F.lit(after)).alias("html"))


def _part(name: str) -> Column:
    return F.col(f"p_{name}")


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _times(text: str, n: Column) -> Column:
    return F.repeat(F.lit(text), n.cast("int"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division for each part: heading, text, list, images, inputs, embedded objects, a figure and perhaps a table."""
    k = _part("partkey")
    opened = F.concat(F.lit('<div class="'), _pick(list(CLASSES), k % 4), F.lit('"><h3>'), _part("name"), F.lit("</h3><p>"), _part("type"), F.lit(",  <b> "), _part("brand"), F.lit("</b> </p>"))
    listed = F.concat(F.lit('<ul><li><a href="/p/'), k, F.lit('">'), _part("name"), F.lit('</a></li><li><a href="#'), k, F.lit('">'), _part("brand"), F.lit("</a>, "), _part("size"), F.lit("</li></ul>"))
    shown = F.concat(_times('<img src="/a.png">', k % 3), _times("<input>", _part("size") % 2), F.when(k % 5 == 0, '<iframe src="https://www.youtube.com/1"></iframe>').when(k % 5 == 1, '<embed src="/x">').otherwise(""))
    figure = F.concat(F.lit("<figure>"), _times("<span>", k % 7), F.lit('<img src="/f.png">'), _times("</span>", k % 7), F.lit("</figure>"))
    table = F.when(k % 2 == 1, F.concat(F.lit("<table"), F.when(k % 4 == 1, ' summary="s"').otherwise(""), F.lit("><tbody><tr><td><p>"), _part("name"), F.lit("</p></td><td>"), _part("size"), F.lit("</td></tr></tbody></table>"))).otherwise("")
    return built(spark, sf_dir, F.concat(opened, listed, shown, figure, table, F.lit("</div>")), "<html><head><title>Parts</title></head><body><article>", "</article></body></html>")


def subtree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the divisions, lists, navigations and articles of the pages hold."""
    own = pages(spark, sf_dir)
    return trees.subtree_stats(node_table(own), ["page_id"], parts=trees.deals(own)).drop("weight", "depth")


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the divisions, lists and articles of the built pages hold."""
    made = _catalog(spark, sf_dir)
    return trees.subtree_stats(node_table(made), ["page_id"], parts=trees.deals(made)).drop("depth")


#: Tests of ancestors: tag, depth (none up to 0; 3 sees four), condition.
TESTS = {
    "in_table": ("table", -1, None),
    "in_data_table": ("table", 0, lambda x: native.attribute(x["attrs"], "summary") != ""),
    "in_figure": ("figure", -1, None),
    "near_figure": ("figure", 3, None),
    "near_division": ("div", 1, None),
}


def ancestor_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each image, paragraph and link of the built pages, what it lies in."""
    made = _catalog(spark, sf_dir)
    return trees.ancestor_tests(node_table(made), ["page_id"], TESTS, ["img", "p", "a"], parts=trees.deals(made))


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and kinds of tables that are built from parts: a row, or more of them, with spans of all sorts."""
    k, spans = _part("partkey"), list(SPANS)
    kind = F.when(k % 16 == 3, ' role="presentation"').when(k % 16 == 5, ' datatable="0"').when(k % 16 == 9, ' summary="all"').otherwise("")
    inside = F.when(k % 16 == 7, "<caption>Parts</caption>").when(k % 16 == 10, "<caption></caption>").when(k % 16 == 12, "<colgroup></colgroup>").otherwise("")
    row = F.concat(F.lit('<tr rowspan="'), _pick(spans, k % 8), F.lit('"><td colspan="'), _pick(spans, F.floor(k / 2) % 8), F.lit('">'), _part("name"), F.lit("</td><td>"), F.when(k % 16 == 11, "<table><tr><td>a<td>b</table>").otherwise(_part("brand")), F.lit("</td></tr>"))
    rows = F.concat(row, _times("<tr><td>x</td></tr>", _part("size") % 12))
    markup = F.concat(F.lit("<table"), kind, F.lit(">"), inside, F.lit("<tbody>"), rows, F.lit("</tbody></table>"))
    made = built(spark, sf_dir, markup, "<body>", "</body>")
    found = trees.table_sizes(node_table(made), ["page_id"], parts=trees.deals(made))
    names = [F.col(c).cast("long").alias(c) for c in ("n_rows", "n_columns")]
    return found.select("page_id", F.row_number().over(trees.Window.partitionBy("page_id").orderBy("id")).alias("place"), *names, "is_data")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of boxes within boxes; some hold a paragraph that counts, from all of them down to none."""
    k, q = _part("partkey"), F.expr(f"p_partkey div {PER_PAGE}")
    said = F.when((k + q) % (1 + q % 5) == q % 2, F.concat(F.lit("<p>Offered: "), _part("name"), F.lit(", "), _part("type"), F.lit(" and more of it</p>"))).otherwise("<span>none</span>")
    before = F.when(F.col("page_id") % 2 == 1, '<p>Sold by piece.</p><p>no end</p><p><a href="/x">A linked one.</a></p>').otherwise("")
    return built(spark, sf_dir, F.concat(F.lit('<div class="mid"><div class="box">'), said, F.lit("</div></div>")), F.concat(F.lit('<body><div id="all">'), before, F.lit('<div class="outer">')), "</div></div></body>")


def chosen_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements that the articles of `pages` and of the boxes grow from; boxes' pages have numbers below zero."""
    boxes = _boxes(spark, sf_dir).select((-1 - F.col("page_id")).alias("page_id"), "html")
    own = pages(spark, sf_dir).select("page_id", "html").unionByName(boxes)
    found = trees.chosen_tops(node_table(own), ["page_id"], parts=trees.deals(own))
    return found.select("page_id", "id", "tag", F.round("score", 6).alias("score"))


def joined_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which elements beside the chosen ones of the boxes' pages join them, and why."""
    boxes = _boxes(spark, sf_dir)
    return trees.joined_siblings(node_table(boxes), ["page_id"], parts=trees.deals(boxes))


#: What stands between the names of parts: breaks, blanks, a heading.
GAPS = ["<br>", "<br><br>", "<br> <br>", "<br><br><br>", "<br> <br> <br>", "<h2>x</h2>"]


def break_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of breaks between the names of parts, and how much of what follows them makes a paragraph."""
    markup = F.concat(_part("name"), _pick(GAPS, _part("partkey") % len(GAPS)))
    made = built(spark, sf_dir, markup, "<body><div>", "</div></body>")
    return trees.break_chains(node_table(made), ["page_id"], parts=trees.deals(made))


def _with_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with JSON-LD of all sorts, made of their own titles, numbers and URLs."""
    own = pages(spark, sf_dir).select("page_id", "url", "html", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("t"))
    page, title, text = F.col("page_id"), F.regexp_replace("t", "<[^>]*>", ""), F.lit
    quoted = F.expr("substring(to_json(array(regexp_replace(t, '<[^>]*>', ''))), 2, length(to_json(array(regexp_replace(t, '<[^>]*>', '')))) - 2)")
    context = '"@context": "https://schema.org"'
    article = F.concat(text(f'{{{context}, "@type": "NewsArticle", "headline": '), quoted, text(', "author": {"name": " Author '), page, text(' "}, "publisher": {"name": "'), F.col("url"), text('"}, "datePublished": "2020-01-'), page % 28, text('"}'))
    graph = F.concat(text('{"@context": {"@vocab": "http://schema.org/"}, "@graph": [{"@type": "WebSite", "name": "no"}, {"@type": ["Thing", "http://schema.org/Report"], "name": '), quoted, text(', "author": ["x", {"name": "B'), page, text('"}, {"name": "C"}, {"name": 3}]}]}'))
    contents = [
        article,
        F.concat(text('{"@context": ["https://schema.org", {"@vocab": "http://other.org/"}], "@type": "Article", "name": '), quoted, text("}")),
        graph,
        F.concat(text('{"@context": "http://schema.org/", "@type": "Article", "name": 7, "headline": '), quoted, text(', "author": "Ann ", "description": 12}')),
        text(f'{{{context}, "@type": "Article", '),
        F.concat(text(f'[1, {{{context}, "@type": "Person"}}, {{{context}, "@type": "BlogPosting", "name": '), quoted, text(', "description": " About '), page, text(' "}]')),
        F.concat(text("<![CDATA["), article, text("]]>")),
        F.concat(text(f'{{{context}, "@type": "Person"}}</script><script type="application/ld+json">'), graph),
        F.concat(article, text(" 1")),
        F.concat(text(f'{{{context}, "@type": "Article", "name": "zzz zzzz zzzzz", "headline": '), quoted, text("}")),
    ]
    chosen = F.lit("")
    for k, content in enumerate(contents):
        chosen = F.when(page % len(contents) == k, content).otherwise(chosen)
    script = F.concat(text('<script type="application/ld+json">'), chosen, text("</script></head>"))
    return own.select("page_id", F.concat(F.substring_index("html", "</head>", 1), script, F.expr("substring(html, instr(html, '</head>') + 7)")).alias("html"), title.alias("title"))


def page_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON-LD of the pages says, null where it says nothing."""
    nodes = F.col("nodes")
    found = node_table(_with_scripts(spark, sf_dir)).select("page_id", trees.json_ld(trees.ld_scripts(nodes), native.page_title(nodes)).alias("ld"))
    return found.select("page_id", *(F.col(f"ld.{c}").alias(c) for c in ("title", "byline", "excerpt", "site_name", "published_time")))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages that show each document as text and as it is."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    cores = spark.sparkContext.defaultParallelism
    docs = docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs
    text = F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<body><b>"), text, F.lit("</b> <pre>."), text, F.lit("</pre><i> x</i></body>"))
    return node_table(docs.select("doc_id", html.alias("html")), ["doc_id"]).select("doc_id", trees.normalized_text(F.col("nodes")).alias("plain"))


def conditional_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which divisions, lists and tables of the built pages the conditional rules take out."""
    made = _catalog(spark, sf_dir)
    return trees.conditional_removals(node_table(made), ["page_id"], ("div", "ul", "table"), parts=trees.deals(made))


def node_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the boxes' pages by the table function in SQL."""
    register(spark)
    boxes = _boxes(spark, sf_dir)
    return spark.sql("SELECT b.page_id, n.id, n.parent, n.depth, n.pos, n.last_id, n.kind, n.tag, n.text FROM {boxes} b, LATERAL nodes(b.html) n", boxes=boxes)


def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of `pages`, and of pages that are built from parts, some with a base element; these have numbers below zero."""
    k, text = _part("partkey").cast("string"), F.lit
    refs = [("../p/", ""), ("?q=", ""), ("#", ""), ("//other.test/", ""), ("mailto:", "@shop.test"), ("/a b/é", ""), ("./x/../", ""), ("https://else.test/", "?x#"), ("%zz", ""), ("javascript:", "")]
    front, back = (_pick([r[i] for r in refs], _part("partkey") % len(refs)) for i in range(2))
    section = F.concat(text('<a href="'), front, k, back, text('">'), k, text('</a><img srcset="s'), k, text(".png 1x, /b"), k, text('.png 2x">'))
    before = F.when(F.col("page_id") % 2 == 1, '<head><base href="/base/dir/"></head><body>').otherwise("<body>")
    made = built(spark, sf_dir, section, before, "</body>")
    made = made.select((-1 - F.col("page_id")).alias("page_id"), F.concat(text("https://shop.test/list/page?n="), F.col("page_id").cast("string")).alias("url"), "html")
    return trees.absolute_links(node_table(pages(spark, sf_dir).unionByName(made), ["page_id", "url"]), ["page_id"])


QUERIES = {
    "absolute_links": absolute_links,
    "conditional_rules": conditional_rules,
    "node_function": node_function,
    "break_chains": break_chains,
    "page_json_ld": page_json_ld,
    "normalized_texts": normalized_texts,
    "chosen_tops": chosen_tops,
    "joined_siblings": joined_siblings,
    "subtree_stats": subtree_stats,
    "catalog_stats": catalog_stats,
    "ancestor_tests": ancestor_tests,
    "table_sizes": table_sizes,
}


# SQL


def _listed(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


#: Nodes of a part's division, and the id at which it begins: seven nodes stand before the first.
_SECTIONS = f"""
    parts AS (SELECT p_partkey // {PER_PAGE} AS page_id, p_partkey AS k, p_name AS name, p_type AS type, p_brand AS brand, p_size AS size,
              18 + p_partkey % 3 + p_size % 2 + CAST(p_partkey % 5 <= 1 AS INTEGER) + p_partkey % 7 + 8 * (p_partkey % 2) AS nodes FROM part),
    placed AS (SELECT *, CAST(7 + coalesce(sum(nodes) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS id FROM parts)"""
_COUNTS = ["paragraphs", "images", "items", "inputs", "embeds", "commas", "length", "heading_length", "list_length"]

_CATALOG_STATS = f"""
    WITH {_SECTIONS},
    divs AS (SELECT page_id, k, id, 'div' AS tag, 1 + k % 2 AS paragraphs, k % 3 + 1 AS images, 2 AS items, size % 2 AS inputs, CAST(k % 5 <= 1 AS INTEGER) AS embeds, 2 AS commas,
             length(name || type || ', ' || brand || ' ' || name || brand || ', ' || size || CASE WHEN k % 2 = 1 THEN name || size ELSE '' END) AS length, length(name) AS heading_length,
             length(name || brand || ', ' || size) AS list_length, length(name) AS links, length(brand) AS anchors, k % 5 = 0 AS video, {_listed(list(CLASSES.values()))}[k % 4 + 1] AS weight FROM placed),
    lists AS (SELECT page_id, k, id + 8 AS id, 'ul' AS tag, 0 AS paragraphs, 0 AS images, 2 AS items, 0 AS inputs, 0 AS embeds, 1 AS commas, list_length AS length, 0 AS heading_length,
              0 AS list_length, links, anchors, false AS video, 0 AS weight FROM divs),
    articles AS (SELECT page_id, 0 AS k, 6 AS id, 'article' AS tag, {", ".join(f"sum({c}) AS {c}" for c in _COUNTS)}, sum(links) AS links, sum(anchors) AS anchors, bool_or(video) AS video, 0 AS weight FROM divs GROUP BY page_id)
    SELECT page_id, CAST(id AS INTEGER) AS id, tag, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS)}, links + anchors * 0.3::DOUBLE AS link_length, video, CAST(weight AS INTEGER) AS weight
    FROM (FROM divs UNION ALL FROM lists UNION ALL FROM articles)"""

_ANCESTORS = f"""
    WITH {_SECTIONS},
    found AS (SELECT page_id, k, id + 3 AS id, 'p' AS tag, '' AS place FROM placed
              UNION ALL SELECT page_id, k, id + 10, 'a', 'li' FROM placed
              UNION ALL SELECT page_id, k, id + 13, 'a', 'li' FROM placed
              UNION ALL SELECT page_id, k, id + 16 + i, 'img', '' FROM placed, (SELECT unnest([0, 1]) AS i) WHERE i < k % 3
              UNION ALL SELECT page_id, k, id + 16 + k % 3 + size % 2 + CAST(k % 5 <= 1 AS INTEGER) + 1 + k % 7, 'img', 'figure' FROM placed
              UNION ALL SELECT page_id, k, id + nodes - 4, 'p', 'table' FROM placed WHERE k % 2 = 1)
    SELECT page_id, CAST(id AS INTEGER) AS id, tag, place = 'table' AS in_table, place = 'table' AND k % 4 = 1 AS in_data_table, place = 'figure' AS in_figure,
           place = 'figure' AND k % 7 <= 3 AS near_figure, place = '' OR (place = 'figure' AND k % 7 = 0) AS near_division
    FROM found"""

_SIZES = f"""
    WITH own AS (SELECT p_partkey // {PER_PAGE} AS page_id, p_partkey AS k, {_listed(list(SPANS.values()))}[p_partkey % 8 + 1] AS rowspan, {_listed(list(SPANS.values()))}[p_partkey // 2 % 8 + 1] AS colspan, p_size % 12 AS more FROM part),
    tabs AS (SELECT page_id, k, 0 AS nested, rowspan + more + CASE WHEN k % 16 = 11 THEN 1 ELSE 0 END AS n_rows, greatest(colspan + CASE WHEN k % 16 = 11 THEN 3 ELSE 1 END, CASE WHEN k % 16 = 11 THEN 2 ELSE 0 END, CASE WHEN more > 0 THEN 1 ELSE 0 END, 0) AS n_columns FROM own
             UNION ALL SELECT page_id, k, 1, 1, 2 FROM own WHERE k % 16 = 11)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k, nested) AS INTEGER) AS place, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_columns AS BIGINT) AS n_columns,
           CASE WHEN nested = 1 THEN false WHEN k % 16 IN (3, 5) THEN false WHEN k % 16 IN (7, 9, 12) THEN true WHEN k % 16 = 11 THEN false ELSE n_rows >= 10 OR n_columns > 4 OR n_rows * n_columns > 10 END AS is_data
    FROM tabs"""


#: The boxes' pages. A page's divisions are all, its paragraphs beside, outer, and for each part mid, box and what is said.
#: A box with a paragraph has 8 points, outer 5 and a half for each paragraph, all 5 and a third,
#: less its share of links. With one paragraph the
#: box is best, the only one in its mid; with two and more, others are close, and outer is around them; from seven on outer is
#: the best one, and all is around the others. An only child goes up.
_BOXES = f"""
    own AS (SELECT p_partkey // {PER_PAGE} AS q, p_partkey AS k, (p_partkey + p_partkey // {PER_PAGE}) % (1 + p_partkey // {PER_PAGE} % 5) = p_partkey // {PER_PAGE} % 2 AS said,
            CASE WHEN said THEN length('Offered: ' || p_name || ', ' || p_type || ' and more of it') ELSE 4 END AS units FROM part),
    boxes AS (SELECT q, count(*) AS n, count(*) FILTER (WHERE said) AS m, min(k) FILTER (WHERE said) - min(k) AS first, q % 2 = 1 AS beside, CASE WHEN q % 2 = 1 THEN 13 / (33 + sum(units)) ELSE 0 END AS linked FROM own GROUP BY q),
    picked AS (SELECT *, CASE WHEN m = 0 THEN '' WHEN m = 1 AND n > 1 THEN 'mid' WHEN m >= 7 OR NOT beside THEN 'all' ELSE 'outer' END AS top, CASE WHEN beside THEN 12 ELSE 5 END AS outer_id FROM boxes)"""


#: A row of breaks takes what is left of its gap (of "br br br" with blanks between them the last one, and two blanks), then
#: names and single breaks up to the next gap of another kind.
_CHAINS = f"""
    WITH own AS (SELECT p_partkey // {PER_PAGE} AS page_id, p_partkey AS k, p_partkey % 6 AS gap, [1, 2, 3, 3, 5, 2][p_partkey % 6 + 1] + 1 AS nodes, [1, 2, 3, 3, 5, 1][p_partkey % 6 + 1] + 1 AS children FROM part),
    placed AS (SELECT *, 5 + coalesce(sum(nodes) OVER earlier, 0) AS id, coalesce(sum(children) OVER earlier, 0) AS place,
               coalesce(min(CASE WHEN gap > 0 THEN k END) OVER later, max(k) OVER (PARTITION BY page_id)) - k AS n FROM own
               WINDOW earlier AS (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), later AS (PARTITION BY page_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT page_id, CAST(4 AS INTEGER) AS parent, CAST(id + 1 AS INTEGER) AS id, CAST(place + 1 AS INTEGER) AS place, CAST(CASE gap WHEN 3 THEN 3 ELSE 2 END AS BIGINT) AS length,
           CAST(CASE WHEN n = 0 THEN 0 ELSE [0, 1, 0, 3][gap] + 2 * n - 1 END AS BIGINT) AS n_nodes FROM placed WHERE gap BETWEEN 1 AND 4"""


#: Divisions go by their names, stay with a video, and go for too many inputs, embedded objects or images in a row; lists stay;
#: tables stay with a summary (of data), others go if they hold little text.
_CONDITIONAL = f"""
    WITH stats AS (SELECT *, id AS at FROM ({_CATALOG_STATS})),
    divs AS (SELECT page_id, id, tag, weight < 0 OR (NOT video AND (
               (images > 1 AND 2 * paragraphs < images) OR inputs > paragraphs // 3 OR (heading_length < 0.9 * length AND length < 25 AND images NOT IN (1, 2))
               OR (weight < 25 AND link_length / length > 0.2) OR (weight >= 25 AND link_length / length > 0.5) OR (embeds = 1 AND length < 75) OR embeds > 1)) AS goes FROM stats WHERE tag = 'div'),
    lists AS (SELECT page_id, id, tag, false AS goes FROM stats WHERE tag = 'ul'),
    {_SECTIONS},
    tabs AS (SELECT page_id, CAST(id + nodes - 8 AS INTEGER) AS id, 'table' AS tag, k % 4 = 3 AND length(name || size) < 25 AS goes FROM placed WHERE k % 2 = 1)
    FROM divs UNION ALL FROM lists UNION ALL FROM tabs"""

#: A page's nodes as they stand in the markup: document, html, head, body and all; what is beside; outer; and four for each part.
_NODES = f"""
    WITH own AS (SELECT p_partkey // {PER_PAGE} AS q, p_partkey AS k, p_name, p_type, (p_partkey + p_partkey // {PER_PAGE}) % (1 + p_partkey // {PER_PAGE} % 5) = p_partkey // {PER_PAGE} % 2 AS said FROM part),
    places AS (SELECT q, k, k - min(k) OVER (PARTITION BY q) AS i, CASE WHEN q % 2 = 1 THEN 12 ELSE 5 END AS o, CASE WHEN said THEN 'p' ELSE 'span' END AS tag,
               CASE WHEN said THEN 'Offered: ' || p_name || ', ' || p_type || ' and more of it' ELSE 'none' END AS t FROM own),
    ends AS (SELECT q, o, o + 4 * count(*) AS e FROM places GROUP BY q, o),
    found AS (SELECT q, v.id, v.parent, v.depth, v.pos, CASE WHEN v.last < 0 THEN e ELSE v.last END AS last_id, v.kind, v.tag, v.t
              FROM ends, (VALUES (0, -1, 0, 0, -1, 0, '', ''), (1, 0, 1, 0, -1, 1, 'html', ''), (2, 1, 2, 0, 2, 1, 'head', ''), (3, 1, 2, 1, -1, 1, 'body', ''), (4, 3, 3, 0, -1, 1, 'div', '')) AS v(id, parent, depth, pos, last, kind, tag, t)
              UNION ALL SELECT q, v.id, v.parent, v.depth, v.pos, v.last, v.kind, v.tag, v.t
              FROM ends, (VALUES (5, 4, 4, 0, 6, 1, 'p', ''), (6, 5, 5, 0, 6, 2, '', 'Sold by piece.'), (7, 4, 4, 1, 8, 1, 'p', ''), (8, 7, 5, 0, 8, 2, '', 'no end'), (9, 4, 4, 2, 11, 1, 'p', ''),
                   (10, 9, 5, 0, 11, 1, 'a', ''), (11, 10, 6, 0, 11, 2, '', 'A linked one.')) AS v(id, parent, depth, pos, last, kind, tag, t) WHERE q % 2 = 1
              UNION ALL SELECT q, o, 4, 4, CASE WHEN q % 2 = 1 THEN 3 ELSE 0 END, e, 1, 'div', '' FROM ends
              UNION ALL SELECT q, o + 4 * i + j + 1, CASE WHEN j = 0 THEN o ELSE o + 4 * i + j END, 5 + j, CASE WHEN j = 0 THEN i ELSE 0 END, o + 4 * i + 4, CASE WHEN j = 3 THEN 2 ELSE 1 END,
                        CASE j WHEN 2 THEN tag WHEN 3 THEN '' ELSE 'div' END, CASE WHEN j = 3 THEN t ELSE '' END FROM places, (SELECT unnest(range(0, 4)) AS j))
    SELECT q AS page_id, CAST(id AS INTEGER) AS id, CAST(parent AS INTEGER) AS parent, CAST(depth AS INTEGER) AS depth, CAST(pos AS INTEGER) AS pos, CAST(last_id AS INTEGER) AS last_id,
           CAST(kind AS TINYINT) AS kind, tag, t AS text FROM found"""


_LINKS = f"""
    WITH nav AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)"', 1), 1) AS i FROM pages),
    own AS (SELECT p_partkey // {PER_PAGE} AS q, p_partkey AS k, p_partkey // {PER_PAGE} % 2 = 1 AS based, 3 * (p_partkey % {PER_PAGE}) + CASE WHEN p_partkey // {PER_PAGE} % 2 = 1 THEN 5 ELSE 4 END AS id,
            CASE WHEN p_partkey // {PER_PAGE} % 2 = 1 THEN 'https://shop.test/base/dir/' ELSE 'https://shop.test/list/' END AS dir FROM part)
    SELECT page_id, CAST(12 + 3 * i AS INTEGER) AS id, 'href' AS name, CAST(0 AS INTEGER) AS place, regexp_extract(url, '^[a-z]+://[^/]*') || array_to_string(list_transform(string_split(href, ''), lambda x: CASE WHEN x < chr(128) THEN x ELSE url_encode(x) END), '') AS value, '' AS behind FROM nav
    UNION ALL SELECT -1 - q, CAST(id AS INTEGER), 'href', 0, CASE k % 10 WHEN 0 THEN CASE WHEN based THEN 'https://shop.test/base/p/' || k ELSE 'https://shop.test/p/' || k END
        WHEN 1 THEN CASE WHEN based THEN dir ELSE dir || 'page' END || '?q=' || k WHEN 2 THEN CASE WHEN based THEN dir ELSE '' END || '#' || k WHEN 3 THEN 'https://other.test/' || k
        WHEN 4 THEN 'mailto:' || k || '@shop.test' WHEN 5 THEN 'https://shop.test/a%20b/%C3%A9' || k WHEN 6 THEN dir || k WHEN 7 THEN 'https://else.test/' || k || '?x#' ELSE '%zz' || k END, '' FROM own WHERE k % 10 < 9
    UNION ALL SELECT -1 - q, CAST(id + 2 AS INTEGER), 'srcset', 0, dir || 's' || k || '.png', ' 1x,' FROM own
    UNION ALL SELECT -1 - q, CAST(id + 2 AS INTEGER), 'srcset', 1, 'https://shop.test/b' || k || '.png', ' 2x' FROM own"""


def oracle_sql() -> dict[str, str]:
    from pagelift.queries import _decoded, _inner, _units

    units = lambda c: f"CAST({_units(_inner(_decoded(c)))} AS BIGINT)"
    none = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("images", "inputs", "embeds"))
    #: The pages' scaffold: twelve nodes stand before the nav, three for each link in it, then comment and division.
    scaffold = f"""
        WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract_all(html, '(?s)<li><a [^>]*>(.*?)</a></li>', 1) AS names,
             regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS hrefs, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
        s AS (SELECT *, len(names) AS n, {units("array_to_string(names, '')")} AS linked, list_sum(list_transform(names, lambda x: {units('x')})) AS links,
              CAST(length(array_to_string(names, '')) - length(replace(array_to_string(names, ''), ',', '')) AS BIGINT) AS nav_commas FROM a),
        rows AS (SELECT page_id, 12 AS id, 'nav' AS tag, 0 AS paragraphs, n AS items, nav_commas AS commas, linked AS length, 0 AS heading_length, linked AS list_length, links AS link_length FROM s
                 UNION ALL SELECT page_id, 13, 'ul', 0, n, nav_commas, linked, 0, 0, links FROM s
                 UNION ALL SELECT page_id, 15 + 3 * n, 'div', 0, 0, length({_decoded('ad')}) - length(replace({_decoded('ad')}, ',', '')), {units('ad')}, 0, 0, 0 FROM s
                 UNION ALL SELECT page_id, 17 + 3 * n, 'article', len(regexp_extract_all(body, '<p>')), 0, length({_decoded('body')}) - length(replace({_decoded('body')}, ',', '')), {units('body')}, {units('head')}, 0, 0 FROM s)
        SELECT page_id, CAST(id AS INTEGER) AS id, tag, CAST(paragraphs AS BIGINT) AS paragraphs, {none}, CAST(items AS BIGINT) AS items, CAST(commas AS BIGINT) AS commas, CAST(length AS BIGINT) AS length,
               CAST(heading_length AS BIGINT) AS heading_length, CAST(list_length AS BIGINT) AS list_length, CAST(link_length AS DOUBLE) AS link_length, false AS video FROM rows"""
    from pagelift.queries import _SCORES

    tops = f"""
        WITH {_BOXES}, ranked AS ({_SCORES})
        SELECT p.page_id, CASE WHEN tag <> 'body' THEN id END AS id, CASE WHEN tag <> 'body' THEN tag END AS tag, CASE WHEN tag <> 'body' THEN round(score, 6) END AS score
        FROM pages p LEFT JOIN (FROM ranked WHERE rank = 1) r USING (page_id)
        UNION ALL SELECT -1 - q, CAST(CASE top WHEN 'mid' THEN outer_id + 1 + 4 * first WHEN 'outer' THEN outer_id WHEN 'all' THEN 4 END AS INTEGER), CASE WHEN top <> '' THEN 'div' END,
               CASE top WHEN 'mid' THEN 6.5 WHEN 'outer' THEN 5 + m / 2 WHEN 'all' THEN round((5 + m / 3) * (1 - linked), 6) END FROM picked"""
    siblings = f"""
        WITH {_BOXES}
        SELECT q AS page_id, CAST(4 AS INTEGER) AS id, 'div' AS tag, 'top' AS reason FROM picked WHERE top = 'all'
        UNION ALL SELECT q, CAST(outer_id AS INTEGER), 'div', 'top' FROM picked WHERE top = 'outer'
        UNION ALL SELECT q, CAST(v.id AS INTEGER), 'p', v.reason FROM picked, (VALUES (5, 'short'), (7, NULL), (9, NULL)) AS v(id, reason) WHERE top = 'outer' AND beside
        UNION ALL SELECT q, CAST(outer_id + 1 + 4 * i AS INTEGER), 'div', CASE WHEN i = first THEN 'top' END FROM picked, (SELECT unnest(range(0, 8)) AS i) WHERE top = 'mid' AND i < n"""
    from pagelift.queries import _WIDE

    trimmed = f"regexp_replace(t, '^{_WIDE}+|{_WIDE}+$', '', 'g')"
    ld = f"""
        WITH own AS (SELECT page_id, page_id % 10 AS sort, url, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g') AS t FROM pages)
        SELECT page_id, CASE WHEN sort IN (1, 4, 8) THEN NULL WHEN sort = 9 AND {trimmed} = '' THEN 'zzz zzzz zzzzz' ELSE {trimmed} END AS title,
               CASE WHEN sort IN (0, 6) THEN 'Author ' || page_id WHEN sort IN (2, 7) THEN 'B' || page_id || ', C' WHEN sort = 3 THEN 'Ann' WHEN sort IN (5, 9) THEN '' END AS byline,
               CASE WHEN sort = 5 THEN 'About ' || page_id WHEN sort NOT IN (1, 4, 8) THEN '' END AS excerpt,
               CASE WHEN sort IN (0, 6) THEN {trimmed.replace("(t,", "(url,")} WHEN sort NOT IN (1, 4, 8) THEN '' END AS site_name,
               CASE WHEN sort IN (0, 6) THEN '2020-01-' || page_id % 28 WHEN sort NOT IN (1, 4, 8) THEN '' END AS published_time FROM own"""
    texts = f"""
        WITH own AS (SELECT doc_id, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '{_WIDE}+', ' ', 'g')) AS plain FROM documents)
        SELECT doc_id, plain || CASE WHEN plain <> '' THEN ' ' ELSE '' END || '.' || t || CASE WHEN regexp_matches('.' || t, '{_WIDE}$') THEN '' ELSE ' ' END || 'x' AS plain FROM own"""
    return {"absolute_links": _LINKS, "conditional_rules": _CONDITIONAL, "node_function": _NODES, "break_chains": _CHAINS, "page_json_ld": ld, "normalized_texts": texts, "chosen_tops": tops, "joined_siblings": siblings, "subtree_stats": scaffold, "catalog_stats": _CATALOG_STATS, "ancestor_tests": _ANCESTORS, "table_sizes": _SIZES}
