"""URLs as columns against their twins in Python."""

import pytest
from pyspark.sql import functions as F

from pagelift.functions import links, urls
from pagelift.operators import dom, prepare, trees
from pagelift.plans.kernel import node_table
from pagelift.sources.html import ELEMENT, parse

BASES = ["https://site.test/one/two/page?x=1#top", "http://site.test", "http://u:p@site.test:81/a/", "mailto:me@site.test", "", "no scheme", "//host/x", "http://site.test/a%zz", "file:/a/b", "HTTP://Site.test/é/x y"]
REFS = ["", "#", "#part", "?q=2", "?", "sub/deep", "./sub", "../up", "../../../up/.", "/root", "/root/../x/./y/..", "//other.test/z", "//other.test", "https://else.test/a b/ü?v=ü w#f g", "HTTPS://E.test:80", "mailto:you@site.test?s=1", "a:b", "./a:b", "1:2", ":x",
        "%zz", "a%20b", "a%2Fb c", "%e9%41", "x#%zz", "http://[::1]:8/p", "http://a b/", "http://us er@h/", "http://u@h:x/", "///three", "http:rel", "http:/abs", "http:", "tab\there", "//h/é", "//hé.test/x", "日本/語?k=日", "a//b", "/..", "..", ".", "a;b=1,c", "'quote'", "#a b", "x y#é", " spaced ", "javascript:f()", "data:a,b#c", "/x#", "?#", "a?b?c", "a#b#c", "\u00a0x"]


def test_resolution(spark):
    rows = spark.createDataFrame([(b, r) for b in BASES for r in REFS], "b string, r string")
    both = links.parsed(F.col("b")).alias("x"), links.parsed(F.col("r")).alias("y")
    got = rows.select("b", "r", *both).select("b", "r", "x.ok", F.col("y.ok").alias("ok2"), links.written(links.resolved(F.col("x"), F.col("y"))).alias("out")).collect()
    for row in got:
        b, r = urls.parse(row["b"]), urls.parse(row["r"])
        assert (row["ok"], row["ok2"]) == (b is not None, r is not None), row
        if b is not None and r is not None:
            assert row["out"] == str(urls.resolve(b, r)), row


@pytest.mark.parametrize("base", ["", '<base href="/b/c/">', '<base href="https://b.test/x">', '<base href="%zz">', "<base>"])
def test_links(spark, base):
    sets = ["a.png 1x, b.png 2x", "a.png,b.png", "/a b.png 100w,x.png", " x ", "a,b 2x , c", "é.png 1.5x"]
    pages = []
    for i, url in enumerate(BASES):
        body = "".join(f'<a href="{r}">x</a><img src="{r}">' for r in REFS if '"' not in r) + '<a href="a,%20b,%20/c">x</a><a href=" java\tscript:x">y</a>'
        pages.append((i, url, f"<head>{base}<base href=no></head><body>{body}" + "".join(f'<img srcset="{s}">' for s in sets) + '<video poster="p.jpg" src=v></video><source src="s"><p href=x src=y>'))
    table = node_table(spark.createDataFrame(pages, "page_id long, url string, html string"), ["page_id", "url"])
    rows = {}
    for r in sorted(trees.absolute_links(table, ["page_id"]).collect(), key=lambda r: r["place"]):
        rows.setdefault((r["page_id"], r["id"], r["name"]), []).append(r["value"] + r["behind"])
    for i, url, html in pages:
        doc = parse(html)
        order = {x: k for k, x in enumerate(doc.walk())}
        named = [(x, k) for x in order if x.kind == ELEMENT for k in (("href",) if x.tag == "a" else ("src", "poster", "srcset") if x.tag in ("img", "video", "source") else ()) if dom.get(x, k)]
        scripts = {x for x, k in named if x.tag == "a" and dom.get(x, k).strip().replace("\t", "").lower().startswith("javascript:")}
        before = {(x, k): dom.get(x, k) for x, k in named}
        prepare.absolute_links(doc, prepare.base_uri(doc, url), url)
        for x, k in named:
            if x not in scripts:
                own = rows.pop((i, order[x], k))
                assert (",%20" if k == "href" else " " if ", " in before[x, k] and k == "srcset" else "").join(own) == dom.get(x, k), (url, html[:80])
    assert not rows
