import re

import numpy as np
import pyarrow as pa
import pytest

from pagelift.llm import decontam as D

from .helpers import DOCS, docs, empty, odd, text

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def brute(rows, items):
    out = []
    for item, t in items:
        w = WORD.findall((t or "").lower())
        k = min(5, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for doc, u in rows:
            v = WORD.findall((u or "").lower())
            shared = len(grams & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}) if k else 0
            if grams and shared >= 0.8 * len(grams):
                out.append((doc, item, len(grams), shared))
    return sorted(out, key=str)


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def same(rows, its):
    got = sorted((tuple(r)[:4] for r in D.contaminated(rows, its).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in rows.collect()], [(r["item_id"], r["text"]) for r in its.collect()])
    assert got == want
    return got


def test_against_brute_force(spark):
    its = [text(i, n) for i, n in enumerate([5, 6, 8, 9, 12, 13, 20, 21, 36, 37, 70, 130, 300])] + ["one two three", "x", "", None, text(0, 5)]
    long_ = lambda i: text(1000 + i, 400)
    rows = [f"{long_(i)} {t} {long_(i + 500)}" for i, t in enumerate(its)]
    rows += [text(12, 300).upper().replace(" ", ", "), text(11, 130)[:-60], text(10, 60), "three two one", "ONE, two\nthree.", None, ""]
    assert len(same(docs(spark, rows), items(spark, its))) > 20


@pytest.mark.parametrize("cut", [0, 1, 2, 3, 6])
def test_parts_of_items(spark, cut):
    words = text(5, 24).split()
    passage = words[: len(words) - cut]
    got = same(docs(spark, [text(9, 200) + " " + " ".join(passage) + " " + text(8, 100)]), items(spark, [" ".join(words)]))
    assert bool(got) is (cut <= 4)


def test_every_place_in_a_long_text():
    """Signature search alone, for all alignments of windows."""
    item = text(1, 30)
    index = D.ItemIndex.build([0], [item])
    for lead in range(40):
        doc = pa.array([" ".join([text(2, lead), item, text(3, 500)]).lower()])
        assert index.search(doc) == [(0, 0, 26)]


def test_blocks_and_odd_rows(spark):
    its = items(spark, [text(i, 20) for i in range(40)])
    rows = docs(spark, [text(i, 20) + " and " + text(99, 5) for i in range(60)])
    whole = {tuple(r) for r in D.contaminated(rows, its).collect()}
    assert len(whole) == 40 and whole == {tuple(r) for r in D.contaminated(rows, its, block_items=10).collect()}
    got = sorted((tuple(r)[:4] for r in D.contaminated(odd(spark), its).collect()), key=str)
    assert got == []
    assert D.contaminated(empty(spark), its).count() == 0 and D.contaminated(rows, its.limit(0)).count() == 0
    assert D.drop_contaminated(rows, its).count() == 20 and D.drop_contaminated(odd(spark), its).columns == odd(spark).columns


def test_rows_of_one_id_and_of_none(spark):
    its = items(spark, [text(0, 20)])
    rows = [(None, "so " + text(0, 20)), (None, text(1)), (4, text(0, 20)), (4, text(2)), (4, text(0, 20))]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert sorted(((r["doc_id"], r["text"]) for r in D.drop_contaminated(table, its).collect()), key=str) == sorted([(None, text(1)), (4, text(2))], key=str)


def test_recall_of_signatures():
    """Items at the limit of containment, in documents of many windows: recall against brute force."""
    draw = np.random.default_rng(4)
    hits = total = 0
    for seed in range(150):
        words = text(seed, int(draw.integers(9, 80))).split()
        grams = len(words) - 4
        passage = words[: 4 + int(np.ceil(0.8 * grams))]
        index = D.ItemIndex.build([0], [" ".join(words)])
        hits += len(index.search(pa.array([" ".join([text(999, int(draw.integers(0, 300))), *passage, text(998, 200)])])))
        total += 1
    assert hits == total
