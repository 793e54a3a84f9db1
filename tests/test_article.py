"""Extraction by cases: contracts of a document, visibility, URIs, tables, metadata, and plans over tables."""

import time

import pytest
from pyspark.sql import functions as F

from pagelift.operators import clean, dom, metadata, native, trees
from pagelift.operators.article import Failed, Options, extract_node, extract_page
from pagelift.operators.readable import probably_article
from pagelift.plans.kernel import extract_articles, extract_articles_from_nodes, flatten, node_table, to_json, unflatten
from pagelift.sources.html import parse, serialize
from pagelift.sources.pages import read_files

LONG = "This sentence is here so that the paragraph has enough text, commas, and units to count. " * 8
NOW = Options(char_threshold=0)


def page(inside, head="<title>A title of several words here</title>"):
    return f"<html lang=en><head>{head}</head><body>{inside}</body></html>"


def status(markup, url="", options=NOW):
    with pytest.raises(Failed) as e:
        extract_page(markup, url, options)
    return e.value.status


def test_fragment_and_text():
    a = extract_page("<article><h1>Headline</h1><p>First  paragraph.\n</p><p> Second paragraph. 😀</p></article>", "", NOW)
    assert a.text_content.endswith("First paragraph. Second paragraph. 😀") and a.length == len(a.text_content) + 1


def test_preformatted_text_is_kept():
    a = extract_page(page(f"<div><p>{LONG}</p><pre>\n\n  a\n\tb\n</pre><p>After</p></div>"), "", NOW)
    assert "\n  a\n\tb\nAfter" in a.text_content


@pytest.mark.parametrize(
    "markup, want",
    [("<html><head></head></html>", "no_body"), ("<body></body>", None), ("", None), ("<html><head></head><body></body></html>", None), ("<html><head></head>text</html>", None)],
)
def test_pages_without_a_body(markup, want):
    try:
        extract_page(markup, "", NOW)
        found = None
    except Failed as e:
        found = e.status
    assert found == want


def test_no_content_with_the_default_threshold():
    assert status("<body></body>", options=Options()) == "no_content"


@pytest.mark.parametrize("url", ["relative/article", "ftp://x.y/", "https:///a", "https://:443/a", "mailto:x", "https://"])
def test_invalid_urls(url):
    assert status(page("<p>x"), url) == "invalid_url"


def test_element_limit():
    markup = page("<p>x")
    assert extract_page(markup, "", Options(char_threshold=0, max_elements=100)).lang == "en"
    with pytest.raises(Failed) as e:
        extract_page(markup, "", Options(max_elements=1))
    assert (e.value.status, e.value.count, e.value.most) == ("too_many_elements", 5, 1)
    assert str(e.value) == "5 elements exceeds maximum 1"


def test_attempts():
    assert extract_page(page(f"<p>{LONG}")).attempts == 1
    assert extract_page(page("<article><p>Short text of an article, kept.</p></article>"), "", Options(char_threshold=1_000_000)).attempts == 4
    assert extract_page(page(f"<div class=sidebar><p>{LONG}</p></div>")).attempts == 2


def test_unlikely_names_roles_and_hidden_parts_go():
    parts = [("<div class=comment>", False), ("<div class='comment main'>", True), ("<div role=navigation>", False), ("<div hidden>", False), ("<div style='display:none'>", False), ("<div style='display:none!important;display:block'>", False), ("<div style='visibility: HIDDEN'>", False), ("<div aria-hidden=true>", False), ("<div aria-hidden=true class=fallback-image>", True), ("<div aria-modal=true role=dialog>", False)]
    markup = f"<div><p>{LONG}</p>" + "".join(f"{p}<p>Part{i}, {LONG}</p></div>" for i, (p, _) in enumerate(parts)) + "</div>"
    text = extract_page(page(markup)).text_content
    assert [f"Part{i}" in text for i in range(len(parts))] == [kept for _, kept in parts]


def test_input_is_not_changed_and_repeats():
    doc = parse(page(f"<div><h1>A title of several words here</h1><p>{LONG}</p></div>"))
    before = serialize([doc])
    a, b = extract_node(doc, "", Options(char_threshold=1_000_000)), extract_node(doc, "", Options(char_threshold=1_000_000))
    assert serialize([doc]) == before and a == b
    body = dom.first(doc, "body")
    body.detach()
    assert LONG.strip() in extract_node(body, "", NOW).text_content


def test_links():
    inside = f"<div><p>{LONG}<a href='x?y'>1</a> <a href='#s'>2</a> <a href='javascript:v()'>gone</a> <a href=' '>3</a><a href='javascript:x'><b>b</b><img src=i.png></a></p><img src='i.png' srcset='a.png 1x, b.png 2x'><video poster=p.jpg></video></div>"
    a = extract_page(page(inside), "https://e.com/d/p", NOW).content
    for want in ('<a href="https://e.com/d/x?y">1</a>', '<a href="#s">2</a>', "gone ", '<a href="">3</a>', '<span><b>b</b><img src="https://e.com/d/i.png"/></span>', 'srcset="https://e.com/d/a.png 1x, https://e.com/d/b.png 2x"', 'poster="https://e.com/d/p.jpg"'):
        assert want in a, a
    with_base = extract_page(page(inside, "<base href='/b/'><base href='/c/'>"), "https://e.com/d/p", NOW).content
    assert '<a href="https://e.com/b/x?y">' in with_base and '<a href="https://e.com/b/#s">' in with_base


def test_breaks_make_paragraphs():
    a = extract_page(page(f"<div>{LONG}<br> <br>{LONG}second</div>"), "", NOW).content
    assert a.count("<p>") == 2 and "<br" not in a


def test_cleaning():
    inside = f"<div><h1>A title of several words here</h1><p style='x' align=left>{LONG}</p><form><input></form><aside>{LONG}</aside><div class=share-this><p>Share it</p><p>now</p></div><iframe src='https://www.youtube.com/embed/x'></iframe><iframe src='https://ads.example'></iframe><table width=5><tr><td>cell of a table with enough text</td></tr></table><p> </p><h2 class=promo>No</h2><button>b</button><section><h3>More</h3><p><a href=x>{'link ' * 20}</a></p></section><div><h3>More</h3><p><a href=x>{'link ' * 20}</a></p></div></div>"
    a = extract_page(page(inside), "", NOW).content
    assert "youtube" in a and "ads.example" not in a and "<p>cell of a table with enough text</p>" in a
    assert a.count("<h3>More</h3>") == 1  # of the section, which no rule looks at
    for gone in ("style", "align", "<form", "<aside", "Share it", "<h1", "promo", "<button", "width", "<p> </p>"):
        assert gone not in a, (gone, a)


def test_classes():
    inside = f"<div class='page keep x'><p class=y>{LONG}</p><p>{LONG}</p></div>"
    assert 'class="page"' in extract_page(page(inside), "", NOW).content
    assert "keep" in extract_page(page(inside), "", Options(char_threshold=0, classes_to_preserve=("keep",))).content
    assert 'class="y"' in extract_page(page(inside), "", Options(char_threshold=0, keep_classes=True)).content


def test_images():
    inside = f"<div><p>{LONG}</p><img data-src=real.jpg src='data:image/gif;base64,R0lGODlhAQ'><figure data-x=f.png></figure><img class=lazy data-set='a.png 2x'><img alt=x><noscript><img src=n.png></noscript></div>"
    a = extract_page(page(inside), "https://e.com/", NOW).content
    assert 'src="https://e.com/real.jpg"' in a and '<figure data-x="f.png"><img src="https://e.com/f.png"/></figure>' in a and "a.png 2x" in a and "noscript" not in a
    a = extract_page(page(f"<div><p>{LONG}</p><img src=tiny.png data-x=q.png><noscript><img src=real.png></noscript></div>"), "https://e.com/", NOW).content
    assert 'src="https://e.com/real.png"' in a and 'data-old-src="tiny.png"' in a


def table(markup):
    return dom.first(parse(markup), "table")


@pytest.mark.parametrize("markup, want", [("<table role=presentation summary=x>", False), ("<table datatable=0 summary=x>", False), ("<table summary=x>", True), ("<table><caption>c</caption>", True), ("<table><caption></caption><tr><td>", False), ("<table><tr><th>x", True), ("<table><tr><td><table>", False), ("<table>" + "<tr><td>x" * 10, True), ("<table><tr>" + "<td>x" * 5, True), ("<table>" + "<tr><td>x<td>y<td>z<td>w" * 3, True), ("<table><tr rowspan=' 3 '><td>x", False), ("<table><tr rowspan=12><td>x", True)])
def test_data_tables(markup, want):
    assert clean.is_data_table(table(markup)) is want


@pytest.mark.parametrize("style, want", [("display:none", "none"), ("DISPLAY : block ; display:none", "none"), ("display:none!important;display:block", "none"), ("display:none ! important;display:block!important", "block"), ("x;display:none", "none"), ("display", ""), ("display:none;display:", ""), ("display:a!b", "a!b")])
def test_styles(spark, style, want):
    n = dom.element("p", style=style)
    assert dom.style(n, "display") == want
    assert spark.createDataFrame([(style,)], "s string").select(native.style(F.col("s"), "display")).first()[0] == want


@pytest.mark.parametrize("title, h1, want", [
    ("An article about many things | Site", [], "An article about many things"), ("Short | A rather long name of a site", [], "A rather long name of a site"),
    ("Name: the long title of this piece", [], "the long title of this piece"), ("Name: the long title of this piece", ["Name: the long title of this piece"], "Name: the long title of this piece"),
    ("Tiny", ["The only heading has more words"], "The only heading has more words"), ("Tiny", ["a", "b"], "Tiny"), ("News » World » A story of some length", [], "News » World » A story of some length"), ("A longer story of many words » News » World", [], "A longer story of many words » News"), ("", [], ""),
    ("one two three four five six: seven eight nine", [], "one two three four five six: seven eight nine"),
])
def test_titles(spark, title, h1, want):
    assert metadata.heuristic_title(title, [h.strip() for h in h1], [], h1) == want
    row = spark.createDataFrame([(title, h1, [])], "t string, a array<string>, b array<string>")
    assert row.select(native.title(F.col("t"), F.col("a"), F.col("b"))).first()[0] == want


LD = '{"@context": "https://schema.org", "@type": "NewsArticle", "headline": " H ", "author": [{"name": "A"}, {"name": "B"}], "description": "D", "datePublished": "2020", "publisher": {"name": "P"}}'


@pytest.mark.parametrize("source, want", [(LD, "H"), ("<![CDATA[" + LD + "]]>", "H"), ("[1, " + LD + "]", "H"), (LD.replace("NewsArticle", "http://schema.org/Report"), "H"), (LD.replace("NewsArticle", "Recipe"), None), (LD.replace('"https://schema.org"', '["https://schema.org", {"@vocab": null}]'), None), (LD.replace('"https://schema.org"', '{"@vocab": "http://schema.org/"}'), "H"), ('{"@context": "https://schema.org/", "@graph": [{"@type": "x"}, ' + LD + "]}", "H"), ("{bad", None), ('{"a": NaN}', None), ("", None)])
def test_json_ld(source, want):
    found = metadata.json_ld([source], lambda: "")
    assert (found and found.title) == want
    if found:
        assert (found.byline, found.excerpt, found.published_time, found.site_name) == ("A, B", "D", "2020", "P")


def test_metadata_of_a_page():
    head = f"<title>x</title><script type='application/ld+json'>{LD}</script><meta property='og:title' content=O><meta name=author content='C &amp;amp; D'>"
    a = extract_page(page(f"<div><p>{LONG}</p></div>", head), "", NOW)
    assert (a.title, a.byline, a.excerpt, a.site_name, a.published_time) == ("H", "A, B", "D", "P", "2020")
    a = extract_page(page(f"<div dir=rtl><p>{LONG}</p><p>{LONG}</p></div>", head), "", Options(char_threshold=0, disable_json_ld=True))
    assert (a.title, a.byline, a.dir) == ("O", "C & D", "rtl") and a.excerpt == LONG.strip()
    a = extract_page(page(f"<div><p class=byline>By <span itemprop=name>Eve</span></p><p>{LONG}</p></div>"), "", NOW)
    assert a.byline == "Eve" and "Eve" not in a.text_content


HOLDINGS = ["paragraphs", "images", "items", "inputs", "embeds", "commas", "length", "heading_length", "list_length"]
CASES = [("div", -25, 5, 0, 0, 0, 0, 0, 900, 0, 0, 0.0, False, False), ("div", 0, 5, 0, 0, 0, 0, 12, 900, 0, 0, 0.9, False, False), ("div", 0, 1, 3, 0, 0, 0, 1, 500, 0, 0, 0.0, False, False), ("div", 0, 1, 3, 0, 0, 0, 1, 500, 0, 0, 0.0, False, True), ("div", 0, 1, 0, 130, 0, 0, 1, 500, 0, 0, 0.0, False, False), ("ul", 0, 1, 0, 130, 0, 0, 1, 500, 0, 500, 0.3, False, False), ("div", 0, 2, 0, 0, 1, 0, 1, 500, 0, 0, 0.0, False, False), ("div", 0, 3, 0, 0, 1, 0, 1, 500, 0, 0, 0.0, False, False), ("div", 0, 1, 0, 0, 0, 0, 0, 20, 0, 0, 0.0, False, False), ("div", 0, 1, 1, 0, 0, 0, 0, 20, 0, 0, 0.0, False, False), ("div", 0, 1, 0, 0, 0, 0, 0, 20, 20, 0, 0.0, False, False), ("div", 0, 1, 0, 0, 0, 0, 1, 500, 0, 0, 0.25, False, False), ("div", 25, 1, 0, 0, 0, 0, 1, 500, 0, 0, 0.25, False, False), ("div", 25, 1, 0, 0, 0, 0, 1, 500, 0, 0, 0.55, False, False), ("div", 0, 1, 0, 0, 0, 1, 1, 70, 0, 0, 0.0, False, False), ("div", 0, 1, 0, 0, 0, 1, 1, 75, 0, 0, 0.0, False, False), ("div", 0, 1, 0, 0, 0, 2, 1, 500, 0, 0, 0.0, False, False), ("div", 0, 1, 0, 0, 0, 2, 1, 500, 0, 0, 0.0, True, False), ("div", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.0, False, False), ("div", 0, 1, 0, 0, 0, 0, 1, 100, 0, 95, 0.9, False, False)]


def test_conditional_rules(spark):
    rows = spark.createDataFrame(CASES, "tag string, weight int, " + ", ".join(f"{h} int" for h in HOLDINGS) + ", link_density double, video boolean, in_figure boolean")
    rows = rows.withColumn("goes", native.fishy(F.col("tag"), F.col("weight"), {c: F.col(c) for c in rows.columns}))
    for r in rows.collect():
        h = clean.Holdings(**{k: r[k] for k in HOLDINGS}, link_density=r["link_density"], video=r["video"])
        is_list = r["tag"] in ("ul", "ol") or h.length > 0 and h.list_length / h.length > 0.9
        want = True if r["weight"] < 0 else False if h.commas >= 10 or h.video else clean.looks_fishy(h, r["weight"], is_list, lambda r=r: r["in_figure"], 0.0)
        assert r["goes"] == want, r


READABLE = [("<p>" + "readable content " * 40, True), ("<p>short", False), ("<ul><li><p>" + "readable content " * 40, False), ("<div>" + "readable content " * 40, False), ("<div><br>" + "readable content " * 40, True), ("<p class=comment>" + "readable content " * 40, False), ("<p style='display:none'>" + "readable content " * 40, False), ("<p hidden>" + "readable content " * 40, False), ("<pre>" + "readable content " * 40, True), ("<article class='comment main'>" + "readable content " * 40, True)]


def test_probably_articles(spark):
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(READABLE)], "page_id int, html string")
    got = {r["page_id"]: r["readable"] for r in native.probably_articles(node_table(rows)).collect()}
    for i, (markup, want) in enumerate(READABLE):
        assert (probably_article(parse(markup)), got[i]) == (want, want), markup
    assert probably_article(parse("<p>" + "界" * 60), 0, 60) is False and probably_article(parse("<p>" + "😀" * 60), 0, 60)


def test_columns_of_node_tables(spark, sf):
    tables = node_table(spark.read.parquet(f"{sf}/pages.parquet"), ("page_id", "html"))
    nodes = F.col("nodes")
    rows = tables.select("html", "nodes", native.element_count(nodes).alias("n"), native.page_title(nodes).alias("t"), F.transform(native.tagged(nodes, "p", "nav"), lambda n: native.link_density(nodes, n)).alias("d")).collect()
    assert len(rows) == 50
    for r in rows:
        doc = parse(r["html"])
        assert r["n"] == len(dom.below(doc)) and r["t"] == metadata.page_title(doc)
        assert r["d"] == pytest.approx([dom.link_density(n) for n in doc.walk() if n.tag in ("p", "nav")])
        assert serialize([unflatten([x.asDict(True) for x in r["nodes"]])]) == serialize([unflatten(flatten(doc))]) == serialize([doc])


def test_plans(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    whole = {r["page_id"]: r for r in extract_articles(pages).collect()}
    again = {r["page_id"]: r for r in extract_articles_from_nodes(node_table(pages, ("page_id", "url"))).collect()}
    assert whole == again and all(r["status"] == "ok" for r in whole.values())
    for r in pages.collect():
        assert whole[r["page_id"]]["content"] == extract_page(r["html"], r["url"]).content
        assert whole[r["page_id"]]["length"] == len(whole[r["page_id"]]["text_content"].encode("utf-16-le")) // 2
    odd = spark.createDataFrame([(1, None, "x"), (2, "<p>x", "bad"), (3, "", None), (4, "<html><head></head></html>", None)], "page_id int, html string, url string")
    assert {r["page_id"]: r["status"] for r in extract_articles(odd).collect()} == {1: "read_error", 2: "invalid_url", 3: "no_content", 4: "no_body"}
    assert extract_articles(odd.limit(0)).count() == 0
    assert to_json(extract_articles(odd)).filter("json is not null").count() == 0


def test_scores(spark):
    markup = page(f"<div id=a class=article><p>{LONG}</p><p>{LONG}</p></div><div id=b><p>{LONG}</p></div>")
    rows = spark.createDataFrame([(1, markup)], "page_id int, html string")
    top = trees.top_candidates(trees.content_scores(node_table(rows), ["page_id"]), ["page_id"]).orderBy("rank").collect()
    one = 2 + LONG.count(",") + 3
    assert [(r["tag"], r["score"]) for r in top] == [("div", 5 + 25 + 2 * one), ("body", 3 * one / 2), ("div", 5 + one)]


def test_stream(spark, sf):
    from pagelift.queries import stream_articles

    assert stream_articles(spark, sf).count() == 50


def test_sql_functions(spark):
    from pagelift.plans.register import register

    register(spark)
    row = spark.sql(f"SELECT extract_article('<p>{LONG}', 'https://e.com').length AS n, probably_article('<p>x') AS p, plain_text_length('A😀') AS u, absolute_url('https://e.com/a/', '../b') AS a").first()
    assert row["n"] == len(LONG.strip()) and (row["p"], row["u"], row["a"]) == (False, 3, "https://e.com/b")


def test_files(spark, tmp_path):
    from pagelift.sources.pages import read_files

    (tmp_path / "a.html").write_text("<p>x")
    assert [(r["url"], r["html"]) for r in read_files(spark, str(tmp_path), "https://e.com/").collect()] == [("https://e.com/a.html", "<p>x")]


def test_files_of_any_bytes(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>caf\xe9 \xff</p>")
    (tmp_path / "b.html").write_bytes(b"")
    rows = {r["url"]: r["html"] for r in read_files(spark, str(tmp_path), "https://e.com/").collect()}
    assert rows == {"https://e.com/a.html": "<p>caf\ufffd \ufffd</p>"}


def test_halves_of_surrogate_pairs():
    assert metadata.loads('{"\\ud800": ["a \\udc00 b", "\\ud83d\\ude00"]}') == {"\ufffd": ["a \ufffd b", "\U0001f600"]}


def test_the_page_id_is_an_option():
    page = "<article><p>" + "some words, and more of them. " * 30 + "</p></article>"
    assert extract_page(page).content.startswith('<div id="page-1" class="page">')
    assert extract_page(page, options=Options(page_id="own")).content.startswith('<div id="own" class="page">')


def test_flat_pages_take_linear_time():
    times = []
    for n in (2_000, 16_000):
        page = "<body>" + "".join(f"<p>paragraph {i} has some words, and more.</p>" + "<div class=sidebar>x</div>" * (i % 3 == 0) for i in range(n))
        began = time.process_time()
        extract_page(page)
        times.append(time.process_time() - began)
    assert times[1] < 20 * times[0] + 1, times
