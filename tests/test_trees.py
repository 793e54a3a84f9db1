"""Relations over whole trees against the kernel's walks, on made-up pages with spaces, nesting and neighbours of all sorts."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagelift.functions import matchers
from pagelift.functions.text import plain
from pagelift.operators import article, clean, dom, metadata, native, prepare, trees
from pagelift.plans.kernel import node_table
from pagelift.sources.html import ELEMENT, parse

WORDS = ["a,b", "word", "  two  ", "\n\n", "x y", " ", " ", "é😀", "tab\t\tend", "，", "end ", " start", "www", "   ", "One sentence. Two.", "A long enough text, with commas, to be a paragraph that counts for a score. "]
ALONE = ['<img src="a.png">', "<input>", "<br>", '<iframe src="//www.youtube.com/x"></iframe>', '<embed src="y">', "<!-- c, -->", "<br><br>", "<br> <br>"]
TAGS = ["div", "p", "ul", "li", "h2", "a", "span", "article", "nav", "table", "section", "object", "form", "ins", "td", "pre"]
ATTRIBUTES = ["", "", ' class="content"', ' id="sidebar"', ' href="#x"', ' href="/y"', ' class="a b"']


def made(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 5)):
        r = rng.random()
        if r < 0.5 or depth > 7:
            out.append(rng.choice(WORDS))
        elif r < 0.62:
            out.append(rng.choice(ALONE))
        else:
            tag = rng.choice(TAGS)
            out.append(f"<{tag}{rng.choice(ATTRIBUTES)}>{made(rng, depth + 1)}</{tag}>")
    return "".join(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    return [(i, f"<html><body>{made(rng)}{made(rng)}{made(rng)}</body></html>") for i in range(80)] + [(1000, "<div>" * 300 + "deep , text  here" + "</div>" * 300), (1001, None), (1002, ""), (1003, "<body>only text")]


@pytest.fixture(scope="module")
def nodes(spark, pages):
    return node_table(spark.createDataFrame(pages, "page_id long, html string")).cache()


def walked(pages):
    """page, id and node of every element."""
    return [(i, k, x) for i, html in pages if html is not None for k, x in enumerate(parse(html).walk()) if x.kind == ELEMENT]


def test_subtree_stats(pages, nodes):
    got = {(r["page_id"], r["id"]): r for r in trees.subtree_stats(nodes, ["page_id"], TAGS).collect()}
    for i, k, x in walked(pages):
        if x.tag in TAGS:
            h, g = clean.holdings(x, re.compile(matchers.VIDEOS)), got.pop((i, k))
            counts = (h.paragraphs, h.images, h.items, h.inputs, h.embeds, h.commas, h.length, h.heading_length, h.list_length, h.video)
            assert counts == (g["paragraphs"], g["images"], g["items"], g["inputs"], g["embeds"], g["commas"], g["length"], g["heading_length"], g["list_length"], g["video"])
            assert (g["link_length"] / g["length"] if g["length"] else 0.0) == pytest.approx(h.link_density)
            assert g["weight"] == matchers.class_weight(dom.get(x, "class"), dom.get(x, "id"))
    assert not got


def test_ancestors(pages, nodes):
    tests = {"li": ("li", -1, None), "table": ("table", 3, None), "nav": ("nav", 0, None), "div": ("div", 1, None), "content": ("div", -1, lambda x: native.attribute(x["attrs"], "class") == "content")}
    got = {(r["page_id"], r["id"]): tuple(r[k] for k in tests) for r in trees.ancestor_tests(nodes, ["page_id"], tests).collect()}
    for i, k, x in walked(pages):
        assert got.pop((i, k)) == (dom.under(x, "li"), dom.under(x, "table", 4), dom.under(x, "nav"), dom.under(x, "div", 2), dom.under(x, "div", only=lambda a: dom.get(a, "class") == "content"))
    assert not got


def attempt(html):
    """An attempt over a page as it is parsed, its candidates from best to worst, and places of nodes."""
    doc = parse(html)
    run = article.Attempt(doc, "", "", article.Options(), True, True, True)
    met = run.score([x for x in doc.walk() if x.kind == ELEMENT and x.tag in article.SCORED])
    order = {x: k for k, x in enumerate(doc.walk())}
    run.options = article.Options(top_candidates=len(met))
    return run, run.best(met), order


def test_content_scores(pages, nodes):
    got = {(r["page_id"], r["id"]): r["score"] for r in trees.content_scores(nodes, ["page_id"]).collect()}
    for i, html in pages:
        if html is not None:
            run, best, order = attempt(html)
            for n in best:
                assert got.pop((i, order[n])) == pytest.approx(run.scores[n])
    assert not got


def test_chosen_tops_and_siblings(spark, pages, nodes):
    rng = random.Random(9)
    box = lambda: f"<div class={rng.choice(['a', 'b'])}><p>{'Some text, of which there is enough. ' * rng.randint(1, 4)}</p></div>"
    more = [(2000 + i, "<body>" + "".join(rng.choice(["<section>", "<div class=a>", "<div>"]) + "".join(box() for _ in range(rng.randint(1, 5))) + rng.choice(["<p>Short one.</p>", "<p>none", "<p><a href=x>A link.</a>", f"<p>{'long text ' * 9}</p>", ""]) for _ in range(rng.randint(1, 4)))) for i in range(60)]
    table = nodes.unionByName(node_table(spark.createDataFrame(more, "page_id long, html string")))
    tops = {r["page_id"]: r for r in trees.chosen_tops(table, ["page_id"]).collect()}
    beside = {}
    for r in trees.joined_siblings(table, ["page_id"]).collect():
        beside.setdefault(r["page_id"], {})[r["id"]] = r["reason"]
    reasons = set()
    for i, html in pages + more:
        if html is None:
            continue
        run, best, order = attempt(html)
        top, made = run.choose(best[:5])
        got = tops.pop(i)
        if made:
            assert got["id"] is None and i not in beside
            continue
        assert (got["id"], got["tag"]) == (order[top], top.tag) and got["score"] == pytest.approx(run.scores[top])
        own = beside.pop(i)
        assert set(own) == {order[x] for x in dom.elements(top.parent)}
        for x in dom.elements(top.parent):
            assert (own[order[x]] is not None) == run._joins(x, top, max(10.0, run.scores[top] * 0.2))
        reasons |= set(own.values())
    assert not tops and not beside and reasons == {None, "top", "score", "long", "short"}


def test_conditional_removals(pages, nodes, monkeypatch):
    tags, goes = ["form", "table", "ul", "div", "section"], {}
    monkeypatch.setattr(clean, "remove_each", lambda found, when: goes.update({n: when(n) for n in found}))
    got = {(r["page_id"], r["id"]): r["goes"] for r in trees.conditional_removals(nodes, ["page_id"], tags).collect()}
    n = 0
    for i, html in pages:
        if html is None:
            continue
        doc = parse(html)
        rules = clean.Rules(re.compile(matchers.VIDEOS), 0.0, True, True, {t for t in dom.below(doc, "table") if clean.is_data_table(t)})
        goes.clear()
        for tag in tags:
            clean.clean_conditionally(doc, tag, rules)
        for k, x in enumerate(doc.walk()):
            if x.kind == ELEMENT and x.tag in tags:
                assert got.pop((i, k)) == goes[x]
                n += goes[x]
    assert not got and n > 20


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_those_that_were_asked_for(spark, nodes):
    """Each relation deals nodes once, into as many parts as its caller counts, whatever the session's setting is."""
    table = node_table(spark.createDataFrame([(1, "<ul><li>a<br><br>b")], "page_id long, html string"))
    found = [trees.subtree_stats(table, ["page_id"], parts=7), trees.ancestor_tests(table, ["page_id"], {"in": ("li", -1, None)}, parts=7), trees.table_sizes(table, ["page_id"], parts=7), trees.break_chains(table, ["page_id"], parts=7), trees.content_scores(table, ["page_id"], parts=7), trees.chosen_tops(table, ["page_id"], parts=7), trees.joined_siblings(table, ["page_id"], parts=7)]
    for df in found:
        own = plan(df)
        assert own.count("Exchange hashpartitioning") == 1 and ", 7)" in own and own.count("MapInArrow") == 1 and "Join" not in own


def test_conditional_removals_take_one_pass(spark, nodes):
    """No join, so nothing is sent to the driver to be broadcast, and one exchange of the parts that were asked for."""
    table = node_table(spark.createDataFrame([(1, "<ul><li>a")], "page_id long, html string"))
    own = plan(trees.conditional_removals(table, ["page_id"], ["ul"], parts=7))
    assert "Join" not in own and "Broadcast" not in own and own.count("MapInArrow") == 1
    assert own.count("Exchange hashpartitioning") == 1 and "hashpartitioning(page_id" in own and ", 7)" in own
    made = lambda n: spark.range(n).select(F.repeat(F.lit("x"), 1 << 20).alias("html"))
    assert trees.deals(made(200)) == 100 and trees.deals(made(0)) == spark.sparkContext.defaultParallelism


GAPS = ["<br>", "<br>", "<br>", " ", "\n", "\xa0", "<!-- c -->", "some text", "<b>bold</b>", "<h2>x</h2>", "<a href=x>link</a>", "<a href=x><div>no</div></a>", "<ins><del>t</del></ins>", "<ins><span><div>in</div></span></ins>"]


def test_break_chains(spark, pages, nodes):
    """As many nodes go into the paragraphs that the kernel makes, at the same places."""
    rng = random.Random(3)
    more = [(2000 + i, "<body><div>" + "".join(rng.choice(GAPS) for _ in range(rng.randint(1, 25))) + "</div><p>" + "".join(rng.choice(GAPS[:8]) for _ in range(9))) for i in range(150)]
    table = nodes.unionByName(node_table(spark.createDataFrame(more, "page_id long, html string")))
    got = {}
    for r in trees.break_chains(table, ["page_id"]).collect():
        got.setdefault(r["page_id"], []).append((r["id"], r["length"], r["n_nodes"]))
    n = 0
    for i, html in pages + more:
        if html is None:
            continue
        doc = parse(html)
        order = {x: k for k, x in enumerate(doc.walk())}
        breaks = [x for x in doc.walk() if x.tag == "br"]
        prepare.breaks_to_paragraphs(dom.first(doc, "body"))
        left = {x for x in doc.walk() if x.tag == "br"}
        made = [x for x in doc.walk() if x.kind == ELEMENT and x not in order]
        own = sorted(got.pop(i, []))
        assert sorted(x[2] for x in own) == sorted(len(x.children) for x in made)
        cut = sum(1 for x in breaks if x not in left)
        trimmed = cut - sum(length for _, length, _ in own)
        assert trimmed >= 0  # breaks at the end of a paragraph go, too
        n += len(own)
    assert not got and n > 100


def test_break_rows(spark):
    pages = [(1, "<div>a<br> <br>b<br>c<br><br><br> d<b>e</b><h2>f</h2>g<br> <br> <br>h<br> <br> <br> <br> <br>i</div>")]
    got = trees.break_chains(node_table(spark.createDataFrame(pages, "page_id long, html string")), ["page_id"]).orderBy("id").collect()
    assert [(r["length"], r["n_nodes"]) for r in got] == [(2, 4), (3, 2), (2, 4), (2, 0), (2, 4)]


def test_normalized_texts(spark, pages, nodes):
    rng = random.Random(5)
    part = lambda: rng.choice(WORDS + ["<pre>", "</pre>", "<textarea>", "</textarea>", "<b>", "</b>", "<p>", "\n"])
    more = [(2000 + i, "".join(part() for _ in range(rng.randint(0, 25)))) for i in range(200)]
    table = nodes.unionByName(node_table(spark.createDataFrame(more, "page_id long, html string")))
    got = {r["page_id"]: r["t"] for r in table.select("page_id", trees.normalized_text(F.col("nodes")).alias("t")).collect()}
    for i, html in pages + more:
        if html is not None:
            assert got[i] == plain(article._pieces(parse(html)))


LD = [
    {"@context": "https://schema.org", "@type": "NewsArticle", "headline": " H ", "author": {"name": " A "}, "publisher": {"name": "P"}, "datePublished": "2020", "description": " d "},
    {"@context": ["https://schema.org", {"@vocab": "http://other.org/"}], "@type": "Article", "name": "no"},
    {"@context": [{"@vocab": None}, ["x", [{"@vocab": "http://schema.org/"}]]], "@graph": [1, {"@type": "WebSite"}, {"@type": ["Thing", ["https://schema.org/Report"]], "name": "N", "author": ["x", {"name": "B"}, {"name": 1}, {"name": " C"}]}]},
    {"@context": "http://schema.org/", "@type": "Article", "name": 7, "headline": True, "author": 3, "description": 12, "publisher": "p"},
    [1, {"@context": "https://schema.org", "@type": "Person"}, {"@context": "https://schema.org", "@type": "BlogPosting", "name": "x"}],
    {"@context": "https://schema.org", "@type": "Article", "name": "Other words altogether", "headline": "A title of several words"},
    {"@context": "https://schema.org", "@type": "Article", "headline": "Other words altogether", "name": "A title of several words"},
    {"@context": {"@vocab": 5}, "@type": "Article"}, {"@type": "Article"}, [], {}, None, "text", 5,
    {"@context": ["https://schema.org", {"other": 1}], "@type": "Article", "name": "", "headline": ""},
]


def test_json_ld(spark):
    rng = random.Random(6)
    sources = [json.dumps(x) for x in LD] + ["", "{", json.dumps(LD[0]) + " 1", json.dumps(LD[0]) + ",1", "1], [2", '1}, {"v": 2', "NaN", f" <![CDATA[{json.dumps(LD[0])}]]> \n"]
    kind = lambda: rng.choice(["application/ld+json"] * 5 + ["text/javascript", "APPLICATION/LD+JSON"])
    pages = [(i, f"<title>A title of several words</title><script type='application/ld+json'>{s}</script>") for i, s in enumerate(sources)]
    pages += [(100 + i, "<title>A title of several words</title>" + "".join(f"<script type='{kind()}'>{rng.choice(sources)}</script>" for _ in range(3))) for i in range(120)]
    nodes = F.col("nodes")
    found = node_table(spark.createDataFrame(pages, "page_id long, html string")).select("page_id", trees.json_ld(trees.ld_scripts(nodes), native.page_title(nodes)).alias("ld"))
    got = {r["page_id"]: r["ld"] and tuple(r["ld"]) for r in found.collect()}
    for i, html in pages:
        doc = parse(html)
        m = metadata.json_ld(metadata.scripts(doc), lambda doc=doc: metadata.page_title(doc))
        assert got[i] == (m and (m.title, m.byline, m.excerpt, m.site_name, m.published_time)), html


SPANS = ["", "2", "0", "x", "+3", "-1", " 4", "12", "1_0", "99999999999999999999", "-99999999999999999999", "9" * 5000, "0007", "٣"]


def test_table_sizes(spark):
    rng = random.Random(2)

    def table(depth=0):
        rows = []
        for _ in range(rng.randint(0, 4)):
            cells = "".join(f'<td colspan="{rng.choice(SPANS)}">{table(depth + 1) if depth < 2 and rng.random() < 0.2 else "x"}</td>' for _ in range(rng.randint(0, 3)))
            rows.append(f'<tr rowspan="{rng.choice(SPANS)}">{cells}</tr>')
        head = rng.choice(["", "", "", "<caption></caption>", "<caption>c</caption>", "<colgroup></colgroup>", "<thead></thead>"])
        return f'<table{rng.choice(["", "", "", " role=presentation", " datatable=0", " summary=s"])}>{head}{"".join(rows)}</table>'

    pages = [(i, f"<body>{table()}{table()}</body>") for i in range(60)]
    got = {(r["page_id"], r["id"]): r for r in trees.table_sizes(node_table(spark.createDataFrame(pages, "page_id long, html string")), ["page_id"]).collect()}
    for i, k, x in walked(pages):
        if x.tag == "table":
            g = got.pop((i, k))
            assert (int(g["n_rows"]), int(g["n_columns"]), g["is_data"]) == (*clean.table_size(x), clean.is_data_table(x))
    assert not got


def test_deep_and_wide_pages_in_linear_time(spark):
    """A page of 2,000 nested divisions, one of 20,000 paragraphs: neither takes longer than its nodes."""
    pages = [(1, "<div>" * 2000 + "<p>Some text, that is long enough</p>" + "</div>" * 2000), (2, "<li>" + "<p>Some text, that is long enough<br></p>" * 20_000)]
    table = node_table(spark.createDataFrame(pages, "page_id long, html string")).cache()
    assert table.count() == 2
    trees.subtree_stats(table, ["page_id"]).count()
    began = time.time()
    deepest = trees.subtree_stats(table, ["page_id"]).filter("page_id = 1").orderBy("id").collect()
    assert len(deepest) == 2000 and {r["length"] for r in deepest} == {len("Some text, that is long enough")}
    assert trees.ancestor_tests(table, ["page_id"], {"in_list": ("li", -1, None)}, ["p"]).filter("in_list").count() == 20_000
    assert time.time() - began < 20
