"""Text, names and URLs: the kernel's functions by cases, and their Column twins against them."""

import math

import pytest
from pyspark.sql import functions as F

from pagelift.functions import matchers, urls
from pagelift.functions import text as X
from pagelift.operators import native

TEXTS = ["", " ", "a", "  a \n\n b\t", " x  y\u000b", "A界😀", "one, two، three， four", "word " * 60, "a  b", "é, è;", "　x"]


def test_utf16():
    assert [X.utf16(t) for t in ("A界😀", "", "abc")] == [4, 0, 3]


def test_three_kinds_of_space():
    assert X.trim("\u000b  x\u0085") == "x"
    assert X.collapse("a \n b\tc  d") == "a b\tc  d"
    assert X.plain([("a  b ", False), (" c", False)]) == "a b c"
    assert X.plain([("Before", False), ("\n  code\n", True), ("After", False)]) == "Before\n  code\nAfter"
    assert X.plain([("  x ", False), ("code", True), (" y", False)]) == "x code y"


def test_similarity():
    assert X.similarity("a b c", "a b c") == 1
    assert X.similarity("x", "a") == 0
    assert math.isnan(X.similarity("x", ""))
    assert X.similarity("the quick fox", "the quick dog") == pytest.approx(1 - 3 / 13)


def test_columns_agree(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    c = F.col("t")
    got = {r["i"]: r for r in rows.select("i", X.utf16_col(c).alias("u"), X.trim_col(c).alias("t"), X.inner_col(c).alias("n"), X.commas_col(c).alias("c"), X.paragraph_score_col(X.inner_col(c)).alias("s"), X.plain_col(c).alias("p"), X.similarity_col(F.lit("a two x"), c).alias("m")).collect()}
    for i, t in enumerate(TEXTS):
        r, m = got[i], X.similarity("a two x", t)
        assert (r["u"], r["t"], r["n"], r["c"], r["s"], r["p"]) == (X.utf16(t), X.trim(t), X.inner(t), X.commas(t), X.paragraph_score(X.inner(t)), X.plain([(t, False)])), t
        assert r["m"] is None if math.isnan(m) else r["m"] == pytest.approx(m)


@pytest.mark.parametrize("value, want", [("share", True), ("share-buttons", True), ("my_share", True), ("sharedaddy", True), ("preshared", False), ("shared", False), ("SHARE2", False)])
def test_share(value, want):
    assert matchers.share(value) is want


@pytest.mark.parametrize("value, want", [("hid", -25), ("x hid", -25), ("hid x", -25), ("a hid b", -25), ("ahid", 0), ("article", 25), ("article-footer", 0), ("", 0)])
def test_weights(value, want):
    assert matchers.class_weight(value, "") == want
    assert matchers.class_weight("", value) == want


def test_name_columns_agree(spark):
    from pagelift.queries import NAMES

    c = F.col("n")
    for r in spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", matchers.unlikely_col(c), matchers.maybe_col(c), matchers.byline_col(c), matchers.share_col(c), matchers.class_weight_col(c, c)).collect():
        n = r["n"]
        assert tuple(r)[1:] == (matchers.unlikely(n), matchers.maybe(n), matchers.byline(n), matchers.share(n), matchers.class_weight(n, n)), n


@pytest.mark.parametrize("uri", ["javascript:x()", " JavaScript:x", "java\tscript:x", "jav\na\rscript\n:x"])
def test_javascript(uri):
    assert matchers.javascript(uri)
    assert not matchers.javascript(uri.replace(":", ""))


@pytest.mark.parametrize(
    "ref, want",
    [
        ("http://u:p@h.test:8/a;b", "http://u:p@h.test:8/a;b"),
        ("ftp://[fe80::7]/x/../y", "ftp://[fe80::7]/y"),
        ("tel:+1-2", "tel:+1-2"),
        ("g%41/%2e#%20z", "https://base.example/dir/g%41/%2e#%20z"),
        ("//h.test?k=v/w", "https://h.test?k=v/w"),
        ("z?", "https://base.example/dir/z?"),
        ("./ü/ñ?ß=1", "https://base.example/dir/%C3%BC/%C3%B1?ß=1"),
        ("../x/./y/..", "https://base.example/x/"),
        ("?q=1", "https://base.example/dir/page?q=1"),
        ("#f", "https://base.example/dir/page#f"),
        ("a b", "https://base.example/dir/a%20b"),
        ("mailto:a@b.c", "mailto:a@b.c"),
    ],
)
def test_resolve(ref, want):
    assert str(urls.resolve(urls.parse("https://base.example/dir/page"), urls.parse(ref))) == want


@pytest.mark.parametrize("bad", ["%zz", "http://a b/", ":x", "a b:c", "http://[::1"])
def test_no_url(bad):
    assert urls.parse(bad) is None


@pytest.mark.parametrize("url, want", [("relative/article", False), ("/article", False), ("ftp://example.com", False), ("https://:443/article", False), ("https:///article", False), ("mailto:a@b", False), ("https://e.com/#top", True), ("HTTP://e.com", True)])
def test_page_urls(spark, url, want):
    assert urls.valid_page_url(url) is want
    assert spark.createDataFrame([(url,)], "u string").select(native.page_url_ok(F.col("u"))).first()[0] is want


def test_similarity_columns_of_long_texts(spark):
    """As in Python, with words that begin like others and many repeats; the time is that of a sort."""
    import random
    import time

    rng = random.Random(8)
    words = ["a", "ab", "abc", "A", "a_", "_", "9", "\u212a", "\u0130x", "é", "zz", "", "!", "#", "a!", "b#", "\n", "😀"]
    some = lambda n: rng.choice([" ", "", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, n)))
    pairs = [(some(6), some(9)) for _ in range(400)] + [("", ""), (None, "a"), ("a", None), ("the " * 30_000, "the " * 30_000), ("the " * 30_000 + "x", "y " * 30_000)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in rows.select("*", X.similarity_col(F.col("a"), F.col("b")).alias("s")).collect():
        want = None if r["a"] is None or r["b"] is None else X.similarity(r["a"], r["b"])
        assert r["s"] is None if want is None or math.isnan(want) else r["s"] == pytest.approx(want, abs=1e-12), (r["a"][:99], r["b"][:99])
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.concat(F.lit("w"), (i + F.col("id")).cast("string"))), " ")
    large = spark.range(1).select(numbers.alias("a"), F.concat(numbers, F.lit(" "), numbers, F.lit(" last")).alias("b"))
    began = time.time()
    assert large.select(X.similarity_col(F.col("a"), F.col("b")).alias("s")).first()["s"] == pytest.approx(1, abs=1e-5)
    assert time.time() - began < 15
