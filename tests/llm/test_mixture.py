"""Filter audit, importance resampling and mixing against plain Python."""

import hashlib
import math
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from pagelift.llm import audit, importance, mixing, queries, runtime

from .helpers import DOCS, docs, empty, odd, text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Filter audit


def audited(table, labels):
    """The rows of the audit by going through every document in every order."""
    fails = []
    for i, t, part in table:
        t, w = t or "", WORD.findall(t or "")
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in table)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy}
        fails.append((part or "", {k for k, v in own.items() if v}, *labels.get(i, (0, 0))))
    out = {}
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for k, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                failing = [f for f in fails if f[0] == part and x in f[1]]
                out[part, order, k] = [len(left), len(gone), len(failing) - len(gone), sum(f[1] == {x} for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    shapley = {}
    for (part, order, k), v in out.items():
        shapley[part, order[k - 1]] = shapley.get((part, order[k - 1]), 0) + v[1]
    return sorted([(p, o, k, *v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()], key=str)


def test_audit(spark):
    rng = np.random.default_rng(3)
    table = []
    for i in range(1, 150):
        t = text(int(rng.integers(0, 60)), int(rng.integers(150, 260)))
        t = t + " same" * 300 if rng.random() < 0.2 else t
        t = t.upper() if rng.random() < 0.2 else t
        table.append((i, t + (" & more" if rng.random() < 0.3 else ""), [None, "", "en", "fr"][int(rng.integers(0, 4))]))
    table += [(None, "", None), (None, "", "en"), (1, None, "en"), (200, "", "en"), (7, table[6][1], "de"), (8, table[6][1], "de")]
    docs = spark.createDataFrame([(i, t, p, "s", 0, 1) for i, t, p in table], DOCS + ", part int")
    labels = {i: (int(rng.random() < 0.4), int(rng.random() < 0.2)) for i in range(1, 250, 2)}
    given = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(5, *labels[5]), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert rows(audit.audit(audit.failures(docs, given))) == audited(table, labels)


def test_audit_of_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(audit.audit(audit.failures(odd(spark), labels)))
    assert got == audited([(r["doc_id"], r["text"], r["lang"]) for r in odd(spark).collect()], {})
    assert audit.audit(audit.failures(empty(spark), labels)).count() == 0


def test_audit_of_many_copies(spark):
    """Copies that are most of the table: all but the first fail E."""
    table = docs(spark, ["copy"] * 3000 + [text(i, 5) for i in range(50)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = audit.audit(audit.failures(table, labels)).filter("filter_order = 'EABCD' and step < 3").orderBy("step").collect()
    assert [(r["kept"], r["removed"], r["unique_fails"], r["good_lost"]) for r in got] == [(51, 2999, 0, 0), (0, 51, 51, 1)]


def test_bitmaps_by_bits():
    rng = np.random.default_rng(1)
    fails, good, toxic, own = (rng.random(s) < 0.4 for s in ((5, 1001), 1001, 1001, 1001))
    got = audit.bitmap_counts(audit._packed(own), audit._packed(fails), audit._packed(good), audit._packed(toxic))
    for mask in range(32):
        left = own & ~np.any([fails[f] for f in range(5) if mask >> f & 1] or [np.zeros(1001, bool)], axis=0)
        for f in range(5):
            if not mask >> f & 1:
                hit = left & fails[f]
                assert list(got[mask, f]) == [left.sum(), hit.sum(), (hit & good).sum(), (hit & toxic).sum()]


# Importance resampling

GRAM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(t, most):
    w = GRAM.findall((t or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)], len(w)


def resampled(table, target, percent, least, buckets, most):
    crc = lambda g: zlib.crc32(g.encode()) % buckets
    own = [[crc(g) for g in grams(t, most)[0]] for _, t in table]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for f in own:
        np.add.at(s, f, 1)
    for _, x in target:
        np.add.at(t, [crc(g) for g in grams(x, most)[0]], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for (i, x), f in zip(table, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, grams(x, most)[1]])
    fit = sorted([r for r in out if r[5] >= least], key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted([tuple(r[:5]) for r in out], key=str)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_importance(spark, most, monkeypatch):
    monkeypatch.setattr(runtime, "RUNNING_ROWS", 20)  # so that ranks come from several ranges
    rng = np.random.default_rng(most)
    some = ["Ünï", "straße", "日本", "alpha", "BETA", "gamma9", "x" * 100, "d-e", "f_g"] + [f"w{i}" for i in range(40)]
    table = [(i, " ".join(rng.choice(some, int(rng.integers(0, 60))))) for i in range(1, 200)]
    table += [(i, table[4][1]) for i in range(300, 340)] + [(None, table[4][1]), (None, None), (7, ""), (7, table[4][1])]
    target = [(i, " ".join(rng.choice(some[:20], 12))) for i in range(20)] + [(99, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 5) for i, t in table], DOCS + ", digest int")
    given = spark.createDataFrame(target, "item_id long, text string")
    got = rows(importance.resample(docs, given, 30, 10, 500, most))
    assert got == resampled(table, target, 30, 10, 500, most)


def test_importance_of_odd_rows(spark):
    given = spark.createDataFrame([(1, "many words"), (2, "many")], "item_id long, text string")
    table = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    assert rows(importance.resample(odd(spark), given)) == resampled(table, [(1, "many words"), (2, "many")], 10, 20, 10_000, 1)
    assert importance.resample(empty(spark), given).count() == 0
    assert rows(importance.resample(odd(spark), given.limit(0))) == resampled(table, [], 10, 20, 10_000, 1)


def test_long_texts_come_in_windows(monkeypatch):
    t = "ab c, defg " * 300 + "z" * 500 + " end-of it"
    for most in (1, 2, 3):
        want = sorted(zlib.crc32(g.encode()) for g in grams(t, most)[0])
        monkeypatch.setattr(importance, "WINDOW", 1 << 22)
        for window in (1 << 22, 100, 17, 1):
            monkeypatch.setattr(importance, "WINDOW", window)
            found = list(importance.features(pa.array([t]), most))
            assert sorted(int(c) for crcs, _, _ in found for c in crcs) == want
            assert sum(len(w) for _, _, w in found) == grams(t, 1)[1]


# Mixing


def levelled(sizes, share=1.0, most=3):
    """Targets by sharing out anew what is above, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, left = {}, float(int(share * sum(sizes.values())))
    going = set(order)
    while going:
        each = left / sum(weight[s] for s in going)
        above = {s for s in going if each * weight[s] >= most * sizes[s]}
        if not above:
            return out | {s: each * weight[s] for s in going}
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        going -= above
    return out


def check_mix(table, got):
    """got: doc_id, size, source_size, target, taken; table: doc_id, text, source."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in table:
        sizes[s] = sizes.get(s, 0) + size(t)
    aims = levelled(sizes)
    assert len(got) == len(table)
    want = sorted(((i, size(t), sizes[s], aims[s]) for i, t, s in table), key=str)
    for a, b in zip(sorted(got, key=str), want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
        assert 0 <= a[4] <= 3 * a[1] and (not a[1] or a[4] % a[1] == 0)
    return sizes, aims


def test_mixing(spark):
    rng = np.random.default_rng(5)
    names = [None, "", "src1", "src10", "src2", "é", "Z"]
    table = [(i, text(i, int(rng.integers(0, 50))), names[min(6, int(rng.integers(0, 14)))]) for i in range(1, 800)]
    docs = spark.createDataFrame([(i, t, "en", s, 0, 3) for i, t, s in table], DOCS + ", size int")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    found = rows(got.select("doc_id", "size", "source_size", "target", "taken"))
    sizes, aims = check_mix(table, found)
    taken = {}
    of = {i: s for i, _, s in table}
    for i, *_, t in found:
        taken[of[i]] = taken.get(of[i], 0) + t
    assert all(abs(taken[s] - aims[s]) <= 25 for s in sizes)  # half of the longest document
    assert rows(mixing.mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken")) == found


def test_budgets_are_nested(spark):
    table = docs(spark, [text(i, 1 + i % 30) for i in range(400)]).selectExpr("doc_id", "text", "lang", "concat('s', doc_id % 4) AS source", "n_chars")
    got = mixing.mix(table, shares=(0.1, 0.5, 1.0, 2.0)).collect()
    assert all(r["taken_0"] <= r["taken_1"] <= r["taken_2"] <= r["taken_3"] <= 3 * r["size"] for r in got)
    words = sum(r["size"] for r in got)
    for k, share in enumerate((0.1, 0.5, 1.0, 2.0)):
        assert abs(sum(r[f"taken_{k}"] for r in got) - share * words) <= 4 * 15


def test_mixing_of_odd_rows(spark):
    for table in (odd(spark), odd(spark).withColumn("source", runtime.F.col("lang"))):
        given = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
        check_mix(given, [tuple(r) for r in mixing.mix(table).select("doc_id", "size", "source_size", "target", "taken").collect()])
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_has_no_python_in_its_plan(spark):
    plan = mixing.mix(docs(spark, [text(i) for i in range(20)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_importance", "op13_mixing"])
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in df.columns) for r in rel.fetchall()), key=str)
    assert rows(df) == want
