"""The engine's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelift import tree_queries
from pagelift.functions import matchers
from pagelift.functions import text as X
from pagelift.operators import metadata as M
from pagelift.operators import native, trees
from pagelift.plans.kernel import extract_articles, extract_articles_from_nodes, node_table, to_json

# What the markup of built pages is varied by, besides the columns of the tables that it is made of.
NAMES = ["", "article-body", "sidebar left", "share-buttons", "sharedaddy", "my_share", "preshared", "byline vcard", "p-author", "hid", "x hid", "hidden", "post-content main", "comment and column", "-ad-", "Footer", "masthead", "pagination", "social", "story text", "author", "skyscraper"]
URLS = ["https://example.com/a", "http://example.com", "HTTP://EXAMPLE.com/x?y#top", "https://user:pw@example.com:8443/p", "http://[2001:db8::1]:80/p", "ftp://example.com/a", "relative/article", "/article", "https://:443/article", "https:///article", "", "http://example.com/#top"]
METAS = [("", "og:title", " A "), ("", "dc:title", "B"), ("author", "", "Ann"), ("", "og:site_name", "Site"), ("DC.Title", "", "First"), ("dc.title", "", "Second"), ("description", "", "Text"), ("twitter:description", "", "Tw"), ("parsely-pub-date", "", "2020-01-01"), ("", "article:published_time", "2021-02-02"), ("parsely-author", "", "Paul"), ("viewport", "", "x"), ("", "og:title", ""), ("weibo:article:title", "", "W"), ("", "x og : title y", "In the middle")]

CLASSES = ["page", "a page b", "  page\tpage ", "pages", "", "x  y", "Page page"]
STYLES = ["display:none", "DISPLAY : block ; display:none", "display:none!important;display:block", "display:none ! important;display:block!important", "x;display:none", "display", "", "display:none;display:", "color:red; display : inline-block ;"]
_LONG = "<p>" + "This sentence is here so that the paragraph has enough text, commas, and units to count. " * 8 + "</p>"
_LD = '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"WebSite"},{"@type":"http://schema.org/Report","name":"Long name of it","headline":"Head","author":[{"name":"A"},{"name":"B"}],"description":"D §","datePublished":"2020","publisher":{"name":"P"}}]}</script>'
#: Sorts of pages: url, markup, and the results; § stands for a supplier's name.
GOLDEN = [  # sort, url, markup, status, title, byline, dir, lang, excerpt, site_name, published_time, attempts
    (1, "", f"<html lang=en><title>A title of several words §</title><body><div dir=rtl>{_LONG}{_LONG}</div>", "ok", "A title of several words §", "", "rtl", "en", _LONG[3:-5], "", "", 1),
    (2, "https://e.com/", f"<title>x</title>{_LD}<div>{_LONG}</div>", "ok", "Long name of it", "A, B", "", "", "D §", "P", "2020", 1),
    (3, "", f"<title>x</title><meta property='og:title' content='O &amp;amp; P'><meta name=author content='Ann §'><meta property='article:published_time' content=2021><meta name=description content=Text><div>{_LONG}</div>", "ok", "O & P", "Ann §", "", "", "Text", "", "2021", 1),
    (4, "", f"<title>The name of a story: part of it</title><div><p class=byline>By <b itemprop=name>Eve §</b></p>{_LONG}</div>", "ok", "The name of a story: part of it", "Eve §", "", "", _LONG[3:-5], "", "", 1),
    (5, "", f"<title>A title of several words</title><div class=sidebar>{_LONG}</div>", "ok", "A title of several words", "", "", "", _LONG[3:-5], "", "", 2),
    (6, "nowhere", _LONG, "invalid_url", None, None, None, None, None, None, None, None),
    (7, "", "<html><head></head></html>", "no_body", None, None, None, None, None, None, None, None),
    (8, "", "", "no_content", None, None, None, None, None, None, None, None),
    (9, "", None, "read_error", None, None, None, None, None, None, None, None),
    (10, "", "<title>A title of several words</title><article><p>Too short, §, yet all there is.</p></article>", "ok", "A title of several words", "", "", "", "Too short, §, yet all there is.", "", "", 4),
]
GOLDEN_NAMES = ["status", "title", "byline", "dir", "lang", "excerpt", "site_name", "published_time", "attempts"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages; fewer partitions than cores (one small file) are dealt anew, as the kernel is what takes time."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    cores = spark.sparkContext.defaultParallelism
    return pages.repartition(cores, "page_id") if pages.rdd.getNumPartitions() < cores else pages


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt anew in the same case."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(_pages(spark, sf_dir))


def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(_pages(spark, sf_dir))


def extract_no_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(_pages(spark, sf_dir), char_threshold=0)


def extract_all_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(_pages(spark, sf_dir), char_threshold=1_000_000)


def extract_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return extract_articles_from_nodes(node_table(pages, ("page_id", "url")))


def article_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_json(extract(spark, sf_dir))


def element_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose elements are more than the limit, with both numbers."""
    found = extract_articles(_pages(spark, sf_dir), max_elements=30)
    return found.filter("status = 'too_many_elements'").select("page_id", "error_count", "error_max")


def probably_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.probably_articles(_nodes(spark, sf_dir)).select("page_id", "readable")


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.id", "n.parent", "n.depth", "n.pos", "n.last_id", "n.kind", "n.tag", "n.text")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = F.col("nodes")
    return _nodes(spark, sf_dir).select("page_id", *(F.size(native.tagged(nodes, t)).cast("long").alias(f"n_{t}") for t in ("a", "li", "h1", "article", "footer", "div")))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("page_id", native.page_lang(F.col("nodes")).alias("lang"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("page_id", native.page_title(F.col("nodes")).alias("title"))


def nav_link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = F.col("nodes")
    rows = _nodes(spark, sf_dir).select("page_id", "nodes", F.explode(native.tagged(nodes, "nav", "article")).alias("n"))
    return rows.select("page_id", F.col("n.tag").alias("tag"), native.link_density(nodes, F.col("n")).alias("density"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return trees.top_candidates(trees.content_scores(node_table(pages), ["page_id"], parts=trees.deals(pages)), ["page_id"]).drop("class", "last_id", "met")


def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.utf16_col(F.col("text")).alias("units"))


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.plain_col(F.col("text")).alias("plain"), X.inner_col(F.col("text")).alias("inner_text"))


def comma_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.inner_col(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", X.commas_col(F.col("text")).cast("int").alias("commas"), X.paragraph_score_col(own).alias("score"))


def text_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document its first line has, and the other way round."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.substring_index("text", "\n", 1).alias("line"))
    # Each step is a row of its own, so that words are looked for once.
    words = docs.select("doc_id", X.words_col(F.col("line")).alias("a"), X.words_col(F.col("text")).alias("b"))
    parts = words.select("doc_id", X.alone_col(F.col("a"), F.col("b")).alias("in_b"), X.alone_col(F.col("b"), F.col("a")).alias("in_a"), X.joined_units_col(F.col("a")).alias("n_a"), X.joined_units_col(F.col("b")).alias("n_b"))
    return parts.select("doc_id", X.share_col(F.col("in_b"), F.col("n_b")).alias("of_text"), X.share_col(F.col("in_a"), F.col("n_a")).alias("of_line"))


def _varied(values: list[str], *more: Column) -> Column:
    """A part's value of a list, by its key, with more of its columns behind it for two of three keys."""
    k = F.col("p_partkey")
    out = F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    return F.concat(out, F.when(k % 3 == 1, F.concat(*more)).when(k % 3 == 2, F.concat(F.lit(" "), F.upper(more[-1]))).otherwise(""))


def _attributes(spark: SparkSession, sf_dir: str, name: str, value: Column) -> DataFrame:
    """k and value: an attribute of the elements of pages that are built from parts, as it is read from their trees."""
    element = F.concat(F.lit('<i id="'), F.col("p_partkey"), F.lit(f'" {name}="'), value, F.lit('"></i>'))
    built = tree_queries.built(spark, sf_dir, element, "<body>", "</body>")
    rows = node_table(built).select(F.explode(native.tagged(F.col("nodes"), "i")).alias("n"))
    return rows.select(native.attribute(F.col("n.attrs"), "id").cast("long").alias("k"), native.attribute(F.col("n.attrs"), name).alias(name))


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What class names say, made of known ones and names and types of parts."""
    rows, c = _attributes(spark, sf_dir, "class", _varied(NAMES, F.lit("-"), F.lower("p_type"), F.lit(" "), F.col("p_name"))), F.col("class")
    return rows.select("k", c.alias("name"), matchers.unlikely_col(c).alias("unlikely"), matchers.maybe_col(c).alias("maybe"), matchers.byline_col(c).alias("byline"), matchers.share_col(c).alias("share"), matchers.class_weight_col(c, F.lit("")).alias("weight"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(u,) for u in URLS], "url string"))
    return rows.select("url", native.page_url_ok(F.col("url")).alias("ok"))


def table_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tables of each page hold data, and how many are layout."""
    sizes = tree_queries.table_sizes(spark, sf_dir)
    return sizes.groupBy("page_id").agg(F.count_if("is_data").alias("data"), F.count_if(~F.col("is_data")).alias("layout"))


def meta_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages with several meta elements, made of parts, give as title, byline and so on."""
    k = F.col("p_partkey")
    name, prop, content = (F.get(F.array(*(F.lit(m[i]) for m in METAS)), (k % len(METAS)).cast("int")) for i in range(3))
    element = F.concat(F.lit('<meta name="'), name, F.lit('" property="'), prop, F.lit('" content="'), F.when(content != "", F.concat(content, F.lit(" "), F.col("p_name"))).otherwise(""), F.lit('">'))
    nodes = node_table(tree_queries.built(spark, sf_dir, element, "<head>", "</head><body>x</body>"))
    metas = F.transform(native.tagged(F.col("nodes"), "meta"), lambda n: F.struct(*(native.attribute(n["attrs"], a).alias(a) for a in ("name", "property", "content"))))
    values = nodes.select("page_id", native.meta_values(metas).alias("v"))
    keys = {"title": M.TITLE_KEYS, "byline": M.BYLINE_KEYS, "excerpt": M.EXCERPT_KEYS, "site_name": M.SITE_KEYS, "published_time": M.TIME_KEYS}
    return values.select("page_id", *(native.first_of(F.col("v"), k).alias(n) for n, k in keys.items()))


def class_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attributes(spark, sf_dir, "class", _varied(CLASSES, F.lit(" "), F.col("p_type"), F.lit("  page")))
    return rows.select("k", F.col("class").alias("value"), native.kept_classes(F.col("class")).alias("kept"))


def inline_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attributes(spark, sf_dir, "style", _varied(STYLES, F.lit(";display: "), F.lower("p_type")))
    return rows.select("k", "style", native.style(F.col("style"), "display").alias("display"))


def golden_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of sorts whose results are known from the rules, with the names of suppliers in them."""
    k = F.col("s_suppkey")
    own = F.get(F.array(*(F.struct(*(F.lit(x).cast("string").alias(c) for x, c in zip(g[1:3], ("url", "html"), strict=True))) for g in GOLDEN)), (k % len(GOLDEN)).cast("int"))
    rows = _table(spark, sf_dir, "supplier").select(k.alias("page_id"), own["url"].alias("url"), F.replace(own["html"], F.lit("§"), F.col("s_name")).alias("html"))
    return extract_articles(rows).select("page_id", *GOLDEN_NAMES)


def stream_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a stream of files, extracted into a table."""
    import tempfile
    import uuid

    from pagelift.streaming.pages import extract_stream, read_pages, write_articles

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="pagelift-")
    out = f"{shared}/pagelift-stream-{uuid.uuid4().hex}"
    pages = read_pages(spark, f"{sf_dir}/pages.parquet*")
    write_articles(extract_stream(pages), f"{out}/articles", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/articles")


QUERIES = {
    "extract_articles": extract,
    "extract_no_retries": extract_no_retries,
    "extract_all_retries": extract_all_retries,
    "extract_from_nodes": extract_from_nodes,
    "article_json": article_json,
    "element_limit": element_limit,
    "probably_articles": probably_articles,
    "node_rows": node_rows,
    "tag_counts": tag_counts,
    "page_languages": page_languages,
    "page_titles": page_titles,
    "nav_link_density": nav_link_density,
    "candidate_scores": candidate_scores,
    "utf16_lengths": utf16_lengths,
    "plain_texts": plain_texts,
    "comma_scores": comma_scores,
    "text_similarities": text_similarities,
    "name_rules": name_rules,
    "page_urls": page_urls,
    "table_kinds": table_kinds,
    "meta_precedence": meta_precedence,
    "class_cleaning": class_cleaning,
    "inline_styles": inline_styles,
    "golden_pages": golden_pages,
    "stream_articles": stream_articles,
    **tree_queries.QUERIES,
}


def _q(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else "NULL" if value is None else str(value)


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) AS v({names})"


_WIDE = X.WIDE_CLASS.replace("\\x{0B}", "\\x0B")
_ASCII = X.ASCII_CLASS


def _units(c: str) -> str:
    return f"CAST(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INTEGER)"


def _inner(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WIDE}+|{_WIDE}+$', '', 'g'), '{_ASCII}{{2,}}', ' ', 'g')"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {_q(w)})" for w in words) + ")"


def _similarity(a: str, b: str) -> str:
    words = lambda c: f"string_split_regex(lower({c}), '[^A-Za-z0-9_]+')"
    other = f"list_filter({words(b)}, lambda w: w <> '' AND NOT list_contains({words(a)}, w))"
    alone = f"(coalesce(list_sum(list_transform({other}, lambda w: length(w))), 0) + greatest(len({other}) - 1, 0))"
    total = f"(len({words(b)}) - 1 + coalesce(list_sum(list_transform({words(b)}, lambda w: length(w))), 0))"
    return f"CASE WHEN {total} > 0 THEN 1.0::DOUBLE - CAST({alone} AS DOUBLE) / CAST({total} AS DOUBLE) END"


def _decoded(c: str) -> str:
    """Text of markup without tags; the references that the pages have."""
    plain = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        plain = f"replace({plain}, '&{name};', '{char}')"
    return f"regexp_replace({plain}, '&amp;?', '&', 'g')"


_SIGNS = r"\|\-–—\\/>»"
_PAGE_TEXT = f"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw, regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1) AS h1 FROM pages"


def _words(c: str) -> str:
    return f"len(string_split_regex({c}, '{_ASCII}+'))"


_TITLES = f"""
    WITH t AS (SELECT page_id, {_inner(_decoded("raw"))} AS t, {_decoded("h1[1]")} AS h, len(h1) AS n_h1 FROM ({_PAGE_TEXT})),
    b AS (SELECT *, regexp_matches(t, ' [{_SIGNS}] ') AS padded, regexp_matches(t, ' [\\\\/>»] ') AS hierarchical,
          regexp_extract(t, '([^\n]*)[{_SIGNS}] [^\n]*', 1) AS cut, regexp_replace(t, '^[^:]*:', '') AS after_first,
          list_last(string_split(t, ':')) AS after_last, string_split(t, ':')[1] AS before,
          regexp_replace(h, '^{_WIDE}+|{_WIDE}+$', '', 'g') = regexp_replace(t, '^{_WIDE}+|{_WIDE}+$', '', 'g') AS same FROM t),
    c AS (SELECT *, CASE WHEN same THEN t ELSE after_last END AS part FROM b),
    d AS (SELECT *, CASE WHEN padded THEN CASE WHEN {_words("cut")} < 3 THEN regexp_replace(t, '^[^{_SIGNS}]*[{_SIGNS}]', '') ELSE cut END
          WHEN contains(t, ': ') THEN CASE WHEN {_words("part")} < 3 THEN after_first WHEN {_words("before")} > 5 THEN t ELSE part END
          WHEN ({_units("t")} > 150 OR {_units("t")} < 15) AND n_h1 = 1 THEN {_inner("h")} ELSE t END AS raw_now FROM c),
    e AS (SELECT *, {_inner("raw_now")} AS now FROM d)
    SELECT page_id, CASE WHEN {_words("now")} <= 4 AND (NOT (padded AND hierarchical) OR {_words("now")} <> {_words(f"regexp_replace(t, '[{_SIGNS}]+', '', 'g')")}) THEN t ELSE now END AS title FROM e"""

_READABLE = f"""
    WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
    parts AS (SELECT page_id, body AS part FROM a
              UNION ALL SELECT page_id, unnest(string_split_regex(body, '<p>')[2:]) FROM a),
    sizes AS (SELECT page_id, length(regexp_replace({_decoded("part")}, '^{_WIDE}+|{_WIDE}+$', '', 'g')) AS n FROM parts),
    scores AS (SELECT page_id, sum(sqrt(n - 140)) AS s FROM sizes WHERE n >= 140 GROUP BY page_id)
    SELECT page_id, coalesce(s > 20, false) AS readable FROM pages LEFT JOIN scores USING (page_id)"""


def _spaced(c: str) -> str:
    return f"regexp_replace({c}, '{_ASCII}+', ' ', 'g')"


def _escaped(c: str) -> str:
    out = _decoded(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        out = f"replace({out}, '{char}', '{name}')"
    return out


def _points(c: str) -> str:
    """Points of a paragraph of 25 units and more."""
    return f"CASE WHEN {_units(c)} >= 25 THEN 2 + length({c}) - length(translate({c}, '{X.COMMAS}', '')) + least({_units(c)} // 100, 3) ELSE 0 END"


#: The pages have one scaffold: a nav, a comment, a div of one text, and the article with its heading and paragraphs, in
#: which a b element is opened here and there and never closed, so that each paragraph after it opens it anew (three of
#: a kind at most). The article and its paragraphs come out, the div as a paragraph before them (but for one of 80 units,
#: which is neither long nor short), the heading as h2 if it is not much like the title, and nav and comment if the body (less its share of links) has more points than the article. Texts of fewer
#: than 500 units are tried four times; the first time such a whole body goes if links are over a fifth of it.
_TRIES = f"CASE WHEN {_units('text_content')} < 500 THEN 4 ELSE 1 END"
_OPEN = "least(3, coalesce(list_sum(bs[:i - 1]), 0))::BIGINT"
_ARTICLES = f"""
    WITH a AS (SELECT page_id, url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
         regexp_extract(html, '<!--.*?-->') AS comment, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS links, regexp_extract_all(html, '(?s)<li><a [^>]*>(.*?)</a></li>', 1) AS names,
         regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS foot, string_split(replace(regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '^<p>', ''), '</p>', ''), '<p>') AS ps, title FROM pages JOIN ({_TITLES}) USING (page_id)),
    b AS (SELECT *, list_transform(ps, lambda p: len(p) - len(replace(p, '<b>', 'bb'))) AS bs, list_transform(ps, lambda p: {_spaced(_decoded('p'))}) AS texts,
          {_spaced(_decoded('ad'))} AS ad_text, list_sum(list_transform(ps, lambda p: {_points(_inner(_decoded('p')))})) AS points, {_points(_inner(_decoded('ad')))} AS ad_points FROM a),
    s AS (SELECT *, length({_inner(_decoded("array_to_string(names, '')"))}) AS linked,
          length({_inner(_decoded("array_to_string(names, '') || ad || head || array_to_string(ps, '') || foot"))}) AS units FROM b),
    c AS (SELECT *, (ad_points + points / 2.0) * (1 - linked / units) > points AS whole, list_transform(ps, lambda p, i: '<p>' || repeat('<b>', {_OPEN})
            || array_to_string(list_transform(string_split(p, '<br>'), lambda x: array_to_string(list_transform(string_split(x, '<b>'), lambda y: {_escaped('y')}), '<b>')), '<br/>')
            || repeat('</b>', ({_OPEN} + bs[i])::BIGINT) || '</p>') AS parts FROM s),
    d AS (SELECT *, whole OR length(ad_text) <> 80 AS with_ad, CASE WHEN whole THEN {_spaced(_decoded("array_to_string(names, '')"))} ELSE '' END AS nav_text,
          CASE WHEN whole THEN '<nav><ul>' || array_to_string(list_transform(links, lambda l, i: '<li><a href="' || regexp_extract(url, '^[a-z]+://[^/]*')
            || array_to_string(list_transform(string_split(l, ''), lambda x: CASE WHEN x < chr(128) THEN x ELSE url_encode(x) END), '') || '">' || {_escaped('names[i]')} || '</a></li>'), '') || '</ul></nav>' || comment ELSE '' END AS nav FROM c),
    h AS (SELECT *, coalesce({_similarity("title", _decoded("head"))}, 0) > 0.75 AS same FROM d),
    e AS (SELECT *, nav_text || CASE WHEN with_ad THEN ad_text ELSE '' END || CASE WHEN same THEN '' ELSE {_spaced(_decoded("head"))} END || array_to_string(texts, '') AS text_content FROM h)
    SELECT e.page_id, 'ok' AS status, CAST(NULL AS INTEGER) AS error_count, CAST(NULL AS INTEGER) AS error_max, title, '' AS byline, '' AS dir, lang,
           '<div id="page-1" class="page">' || nav || CASE WHEN with_ad THEN '<p>' || {_escaped('ad')} || '</p>' ELSE '' END || '<article>' || CASE WHEN same THEN '' ELSE '<h2>' || {_escaped('head')} || '</h2>' END || array_to_string(parts, '') || '</article></div>' AS content,
           text_content, {_units('text_content')} AS length, CASE WHEN with_ad THEN trim({_decoded('ad')}) ELSE trim({_decoded('ps[1]')}) END AS excerpt,
           '' AS site_name, '' AS published_time, CAST({_TRIES} AS INTEGER) AS attempts
    FROM e"""
_JSON = {"title": "title", "byline": "byline", "dir": "dir", "lang": "lang", "content": "content", "textContent": "text_content", "length": "length", "excerpt": "excerpt", "siteName": "site_name", "publishedTime": "published_time"}
#: Elements: 13 of the scaffold, two for each link, paragraphs, breaks, and b elements as they are opened and opened anew,
#: the last time in the footer.
_ELEMENTS = f"""
    WITH a AS (SELECT page_id, html, string_split(regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '^<p>', ''), '<p>') AS ps FROM pages),
    b AS (SELECT *, list_transform(ps, lambda p: len(p) - len(replace(p, '<b>', 'bb'))) AS bs FROM a),
    c AS (SELECT page_id, CAST(13 + 2 * len(regexp_extract_all(html, '<li>')) + len(ps) + len(regexp_extract_all(html, '<br>')) + list_sum(bs)
          + list_sum(list_transform(bs, lambda n, i: {_OPEN})) + least(3, list_sum(bs)) AS INTEGER) AS error_count FROM b)
    SELECT page_id, error_count, CAST(30 AS INTEGER) AS error_max FROM c WHERE error_count > 30"""

#: The article has the points of its paragraphs, the body half of them less its share of links. Their places: twelve
#: nodes stand before the nav, three for each link in it, and five up to the article.
_SCORES = f"""
    WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<body>(.*)', 1) AS body, regexp_extract_all(html, '(?s)<li><a [^>]*>(.*?)</a></li>', 1) AS names,
         string_split(replace(regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '^<p>', ''), '</p>', ''), '<p>') AS ps FROM pages),
    b AS (SELECT page_id, len(names) AS n, list_sum(list_transform(names, lambda x: {_units(_inner(_decoded('x')))})) AS linked,
          {_units(_inner(_decoded("regexp_replace(body, '<!--.*?-->', '')")))} AS units, CAST(list_sum(list_transform(ps, lambda p: {_points(_inner(_decoded('p')))})) AS DOUBLE) AS points FROM a),
    c AS (SELECT page_id, CAST(17 + 3 * n AS INTEGER) AS id, 'article' AS tag, points AS score FROM b WHERE points > 0
          UNION ALL SELECT page_id, CAST(11 AS INTEGER), 'body', points / 2 * (1 - linked / units) FROM b WHERE points > 0)
    SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM c"""



def _varied_sql(values: list[str], first: str, second: str) -> str:
    listed = ", ".join(map(_q, values))
    return f"[{listed}][p_partkey % {len(values)} + 1] || CASE p_partkey % 3 WHEN 1 THEN {first} WHEN 2 THEN ' ' || upper({second}) ELSE '' END"


ORACLE_SQL = {
    "extract_articles": _ARTICLES,
    "extract_all_retries": _ARTICLES.replace(_TRIES, "4"),
    "extract_no_retries": f"""
        SELECT page_id, status, error_count, error_max, title, byline, dir, lang, CASE WHEN goes THEN '' ELSE content END AS content, CASE WHEN goes THEN '' ELSE text_content END AS text_content,
               CASE WHEN goes THEN 0 ELSE length END AS length, CASE WHEN goes THEN '' ELSE excerpt END AS excerpt, site_name, published_time, CAST(1 AS INTEGER) AS attempts
        FROM (SELECT *, length(regexp_replace(array_to_string(regexp_extract_all(content, '(?s)<a [^>]*>(.*?)</a>', 1), ''), '&[a-z0-9#]+;', '_', 'g')) > 0.2 * length AS goes FROM ({_ARTICLES}))""",
    "extract_from_nodes": _ARTICLES,
    "stream_articles": _ARTICLES,
    "article_json": "SELECT page_id, '{' || " + " || ',' || ".join(f"'\"{k}\":' || CAST(to_json({c}) AS VARCHAR)" for k, c in _JSON.items()) + f" || '}}' AS json FROM ({_ARTICLES})",
    "element_limit": _ELEMENTS,
    "candidate_scores": _SCORES,
    "probably_articles": _READABLE,
    "tag_counts": "SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '<{t}[ >]')) AS BIGINT) AS n_{t}" for t in ("a", "li", "h1", "article", "footer", "div")) + " FROM pages",
    "page_languages": """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""",
    "page_titles": _TITLES,
    "nav_link_density": f"""
        WITH parts AS (SELECT page_id, tag, regexp_extract(html, '(?s)<' || tag || '>(.*?)</' || tag || '>', 1) AS part FROM pages, (VALUES ('nav'), ('article')) AS v(tag))
        SELECT page_id, tag, CASE WHEN total > 0 THEN CAST(linked AS DOUBLE) / total ELSE 0.0 END AS density FROM
        (SELECT page_id, tag, {_units(_inner(_decoded("part")))} AS total,
                coalesce(list_sum(list_transform(regexp_extract_all(part, '(?s)<a [^>]*>(.*?)</a>', 1), lambda x: length({_inner(_decoded("x"))}))), 0) AS linked FROM parts)""",
    "utf16_lengths": f"SELECT doc_id, {_units('text')} AS units FROM documents",
    "plain_texts": f"SELECT doc_id, trim(regexp_replace(text, '{_WIDE}+', ' ', 'g')) AS plain, {_inner('text')} AS inner_text FROM documents",
    "comma_scores": f"""
        SELECT doc_id, CAST(length(text) - length(translate(text, '{X.COMMAS}', '')) AS INTEGER) AS commas,
               CAST(2 + length(t) - length(translate(t, '{X.COMMAS}', '')) + least(floor({_units("t")} / 100.0), 3) AS DOUBLE) AS score
        FROM (SELECT doc_id, text, {_inner('text')} AS t FROM documents)""",
    "text_similarities": f"""
        SELECT doc_id, {_similarity("line", "text")} AS of_text, {_similarity("text", "line")} AS of_line
        FROM (SELECT doc_id, text, string_split(text, chr(10))[1] AS line FROM documents)""",
    "name_rules": f"""
        SELECT k, name, {_any("name", matchers.UNLIKELY)} AS unlikely, {_any("name", matchers.MAYBE)} AS maybe, {_any("name", matchers.BYLINE)} AS byline,
               regexp_matches(lower(name), '(^|[^a-z0-9])share(daddy)?([^a-z0-9]|$)') AS share,
               CAST(CASE WHEN {_any("name", matchers.POSITIVE)} THEN 25 ELSE 0 END
                    - CASE WHEN {_any("name", matchers.NEGATIVE)} OR contains(' ' || lower(name) || ' ', ' hid ') THEN 25 ELSE 0 END AS INTEGER) AS weight
        FROM (SELECT p_partkey AS k, {_varied_sql(NAMES, "'-' || lower(p_type) || ' ' || p_name", "p_name")} AS name FROM part)""",
    "page_urls": f"""
        SELECT url, url = '' OR (regexp_matches(lower(url), '^https?://[^/?#]') AND regexp_extract(lower(url), '^https?://([^/?#]*)', 1) NOT LIKE ':%') AS ok
        FROM (SELECT url FROM pages UNION ALL SELECT url FROM {_values([(u,) for u in URLS], "url")})""",
    "table_kinds": f"SELECT page_id, count(*) FILTER (WHERE is_data) AS data, count(*) FILTER (WHERE NOT is_data) AS layout FROM ({tree_queries._SIZES}) GROUP BY page_id",
    "class_cleaning": f"""
        SELECT k, value, array_to_string(list_filter(string_split_regex(value, '{_ASCII}+'), lambda c: c = 'page'), ' ') AS kept
        FROM (SELECT p_partkey AS k, {_varied_sql(CLASSES, "' ' || p_type || '  page'", "'  page'")} AS value FROM part)""",
    "inline_styles": f"""
        WITH v AS (SELECT p_partkey AS k, {_varied_sql(STYLES, "';display: ' || lower(p_type)", "p_type")} AS style FROM part),
        parts AS (SELECT k, unnest(string_split(style, ';')) AS part, generate_subscripts(string_split(style, ';'), 1) AS place FROM v),
        own AS (SELECT k, place, trim(regexp_replace(part, '^[^:]*:', '')) AS given FROM parts WHERE contains(part, ':') AND lower(trim(string_split(part, ':')[1])) = 'display'),
        best AS (SELECT k, max_by(trim(regexp_replace(given, '! *important$', '')), place + 1000 * CAST(regexp_matches(given, '! *important$') AS INTEGER)) AS display FROM own GROUP BY k)
        SELECT k, style, coalesce(display, '') AS display FROM v LEFT JOIN best USING (k)""",
    "golden_pages": f"""
        SELECT s_suppkey AS page_id, {", ".join(f"replace({c}, '§', s_name) AS {c}" for c in GOLDEN_NAMES[:-1])}, CAST(attempts AS INTEGER) AS attempts
        FROM supplier JOIN {_values([(i, *g[3:]) for i, g in enumerate(GOLDEN)], 'sort, ' + ', '.join(GOLDEN_NAMES))} ON s_suppkey % {len(GOLDEN)} = sort""",
    "meta_precedence": f"""
        WITH m AS (SELECT *, CASE
                WHEN regexp_matches(property, '(?i)(article|dc|dcterm|og|twitter)\\s*:\\s*(author|creator|description|published_time|title|site_name)')
                THEN replace(lower(regexp_extract(property, '(?i)(article|dcterm|dc|og|twitter)\\s*:\\s*(author|creator|description|published_time|title|site_name)')), ' ', '')
                WHEN regexp_matches(name, '(?i)^\\s*((dc|dcterm|og|twitter|parsely|weibo:(article|webpage))\\s*[-.:]?\\s*)?(author|creator|pub-date|description|title|site_name)\\s*$')
                THEN replace(replace(lower(name), ' ', ''), '.', ':') END AS key, trim(content) AS value
              FROM (SELECT p_partkey // {tree_queries.PER_PAGE} AS page, p_partkey AS place, name, property, CASE WHEN given <> '' THEN given || ' ' || p_name ELSE '' END AS content
                    FROM part JOIN {_values([(i, *m) for i, m in enumerate(METAS)], "sort, name, property, given")} ON p_partkey % {len(METAS)} = sort)),
        l AS (SELECT page, key, max_by(value, place) AS value FROM m WHERE key IS NOT NULL AND content <> '' GROUP BY page, key),
        g AS (SELECT page, map_from_entries(list((key, value))) AS v FROM l GROUP BY page),
        p AS (SELECT DISTINCT p_partkey // {tree_queries.PER_PAGE} AS page FROM part)
        SELECT page AS page_id, coalesce(v['dc:title'], v['dcterm:title'], v['og:title'], v['weibo:article:title'], v['weibo:webpage:title'], v['title'], v['twitter:title'], v['parsely-title'], '') AS title,
               coalesce(v['dc:creator'], v['dcterm:creator'], v['author'], v['parsely-author'], '') AS byline,
               coalesce(v['dc:description'], v['dcterm:description'], v['og:description'], v['weibo:article:description'], v['weibo:webpage:description'], v['description'], v['twitter:description'], '') AS excerpt,
               coalesce(v['og:site_name'], '') AS site_name, coalesce(v['article:published_time'], v['parsely-pub-date'], '') AS published_time
        FROM p LEFT JOIN g USING (page)""",
}
ORACLE_SQL |= tree_queries.oracle_sql()
