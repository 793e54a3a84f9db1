import hashlib

import numpy as np
import pytest

from pagelift.llm import exact_dedup as D

from .helpers import DOCS, docs, empty, odd, text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    low = [((t or "").translate(LOWER), i) for i, t in rows]
    out = []
    for t, i in low:
        same = [j for u, j in low if u == t]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 100, 20_000])
def test_filter(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    f = D.BinaryFuse8.build(keys)
    assert f.contains(keys).all()
    others = np.random.default_rng(1).integers(0, 2**64, 50_000, np.uint64)
    assert f.contains(others).mean() < 0.01
    assert len(f.fingerprints) < 1.4 * n + 100


def test_against_brute_force(spark):
    rows = docs(spark, [text(i % 7) if i % 3 else text(i % 7).upper() for i in range(40)] + ["É", "é", "A", "a"])
    got = sorted((tuple(r) for r in D.exact_dedup(rows).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in rows.collect()])


def test_odd_rows(spark):
    rows = odd(spark)
    got = sorted((tuple(r) for r in D.exact_dedup(rows).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert D.exact_dedup(empty(spark)).count() == 0
    assert D.drop_copies(rows).columns == rows.columns


def test_rows_of_one_id_and_of_none(spark):
    """Each row is judged by its own text; of rows that are the same in id and text one stays."""
    rows = [(5, "a text"), (5, "unique text"), (9, "A text"), (None, "same"), (5, "same"), (None, "x"), (None, "X"), (7, "twice"), (7, "twice"), (3, None), (4, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = sorted(((r["doc_id"], r["text"] and r["text"].lower()) for r in D.drop_copies(table).collect()), key=str)
    assert kept == sorted([(5, "unique text"), (9, "a text"), (5, "same"), (None, "x"), (7, "twice"), (4, "")], key=str)


def test_a_hot_text(spark):
    rows = docs(spark, ["copy"] * 3000 + [text(i, 5) for i in range(200)])
    got = {r["doc_id"]: r for r in D.exact_dedup(rows).collect()}
    assert len(got) == 3200
    assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (3000, 3000, i == 3000) for i in range(1, 3001))
    assert D.drop_copies(rows).count() == 201


def test_a_stored_snapshot_serves_later_batches(spark, tmp_path, monkeypatch):
    all_ = docs(spark, [text(i % 30, 6) for i in range(60)])
    rows = D.materialize(D.digests(all_), "test")
    old = rows.filter("doc_id <= 40")
    D.Snapshot.build(old, str(tmp_path / "snapshot"))
    monkeypatch.setattr(D, "build_filters", None)  # nothing is built again
    stored = D.Snapshot.load(spark, str(tmp_path / "snapshot"))
    assert (stored.digests, stored.rows, stored.filters.count()) == (30, 40, 1)
    for batch in (rows.filter("doc_id > 40"), rows.filter("doc_id > 55"), rows.limit(0)):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in D.match_batch(batch, old, all_.select("doc_id", "text"), stored).collect()}
        ids = sorted([r["doc_id"] for r in batch.collect()] + list(range(1, 41)))
        assert got == {i: (max(j for j in ids if (j - i) % 30 == 0), sum((j - i) % 30 == 0 for j in ids)) for i in ids}


def test_batch_against_a_snapshot(spark):
    """Copies on either side, and on both."""
    all_ = docs(spark, ["a", "b", "b", "c", "A", "d", "c", "e"])
    rows = D.materialize(D.digests(all_), "test")
    out = D.match_batch(rows.filter("doc_id > 4"), rows.filter("doc_id <= 4"), all_.select("doc_id", "text"))
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out.collect()} == {(1, 5, 2), (5, 5, 2), (2, 3, 2), (3, 3, 2), (4, 7, 2), (7, 7, 2), (6, 6, 1), (8, 8, 1)}
