import re

import numpy as np
import pyarrow as pa
import pytest

from pagelift.llm import jaccard as J
from pagelift.llm import ngrams
from pagelift.llm.components import components

from .helpers import DOCS, docs, empty, odd, text

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted([(i, len(shingles(t)), None if i is None else find(i)) for i, t in rows], key=str)


def same(rows):
    got = sorted((tuple(r) for r in J.near_duplicates(rows).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in rows.collect()])


def edited(seed, words, places):
    w = text(seed, words).split()
    for p in places:
        w[p] = f"edit{seed}{p}"
    return " ".join(w)


def test_against_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [edited(s, 100, draw.integers(0, 100, draw.integers(0, 6))) for s in range(6) for _ in range(8)]
    rows += [text(1, 100).upper(), text(1, 100).replace(" ", " \n\t"), "a b c", "A  B c", "a b", "one", "", None]
    same(docs(spark, rows))


@pytest.mark.parametrize("edge", [0, 1])
def test_just_at_the_limit(spark, edge):
    """Sets of 100 shingles of which 89 (0.802) or 88 (0.786) are shared."""
    w = [f"v{i}" for i in range(104)]
    other = w[: 93 - edge] + [f"u{i}" for i in range(11 + edge)]
    a, b = shingles(" ".join(w)), shingles(" ".join(other))
    assert (100 * len(a & b) >= 80 * len(a | b)) is (edge == 0)
    same(docs(spark, [" ".join(w), " ".join(other)]))


def test_chains_and_a_shared_passage(spark):
    """Neighbours of a chain are linked, its ends are not; a passage in all documents links none."""
    w = text(9, 160).split()
    chain = [" ".join(w[k * 5 : k * 5 + 100]) for k in range(12)]
    passage = text(77, 30)
    rows = chain + [text(100 + i, 60) + " " + passage for i in range(40)] + [passage]
    same(docs(spark, rows))


def test_a_large_group(spark):
    rows = [edited(3, 60, [i % 60]) + f" end{i}" for i in range(400)] + [text(50 + i, 30) for i in range(30)] + ["copy of one text in many rows here"] * 300
    got = {r["doc_id"]: r["component_id"] for r in J.near_duplicates(docs(spark, rows)).collect()}
    assert len({got[i] for i in range(431, 731)}) == 1 and len({got[i] for i in range(401, 431)}) == 30
    same(docs(spark, rows))


def test_odd_rows(spark):
    same(odd(spark))
    assert J.near_duplicates(empty(spark)).count() == 0
    kept = J.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and kept.filter("text = 'same text here for two rows'").count() == 1


def test_rows_of_one_id_and_of_none(spark):
    """Each row is judged by its own text; of rows that are the same in id and text one stays."""
    a, b, c = text(1), text(2), text(3)
    rows = [(5, a), (5, b), (9, edited(1, 40, [39])), (7, b), (None, c), (None, c), (3, c), (None, text(4)), (None, text(4)), (9, text(6)), (2, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.near_duplicates(table).collect()), key=str)
    want = [(5, 5), (5, 5), (9, 5), (7, 5), (None, 3), (None, 3), (3, 3), (None, None), (None, None), (9, 9), (2, 2)]
    assert got == sorted(want, key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in J.keep_one(table).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (3, c), (None, text(4)), (9, text(6)), (2, "")], key=str)


def test_the_order_of_shingles_does_not_matter(spark, monkeypatch):
    rows = docs(spark, [edited(s, 50, [s]) for s in range(5)] * 2 + [text(s, 50) for s in range(5)])
    for levels in (np.zeros(J.CELLS, np.uint8), np.random.default_rng(1).integers(0, 256, J.CELLS).astype(np.uint8)):
        monkeypatch.setattr(J, "word_levels", lambda _, levels=levels: levels)
        same(rows)


def test_word_levels(spark):
    rows = J._rows(docs(spark, ["rare " + "often " * 500, "often", None]), "doc_id", "text")
    levels = J.word_levels(rows)
    cell = lambda w: int(ngrams.words(*ngrams.buffers(pa.array([w])))[0][0] & np.uint64(J.CELLS - 1))
    assert levels[cell("rare")] == 6 and levels[cell("often")] == int(6 * np.log2(502)) and (levels > 0).sum() == 2


def test_parts_and_pieces(spark, monkeypatch):
    """Trees of more leaves than a part has, and lists longer than a piece, give the same."""
    draw = np.random.default_rng(3)
    rows = [edited(s, 60, draw.integers(0, 60, draw.integers(0, 7))) + f" end{i}" for i in range(60) for s in range(2)]
    w = text(9, 300).split()
    rows += [" ".join(w[k * 4 : k * 4 + 80 + k]) for k in range(40)] + [text(20 + i, 50) for i in range(10)]
    table = docs(spark, rows)
    same(table)
    for leaves, shingles, piece in ((8, 1 << 22, 16), (4096, 500, 1 << 20), (3, 300, 5)):
        monkeypatch.setattr(J, "TREE_LEAVES", leaves)
        monkeypatch.setattr(J, "TREE_SHINGLES", shingles)
        monkeypatch.setattr(J, "PIECE", piece)
        same(table)


def many_sets():
    draw = np.random.default_rng(2)
    base = [draw.integers(0, 2**64, n, np.uint64) for n in (300, 300, 400, 520, 520, 700, 900, 150, 300, 300, 520, 520)]
    return [np.unique(np.concatenate([b[: draw.integers(len(b) // 2, len(b))], draw.integers(0, 2**64, draw.integers(1, 90), np.uint64)])) for b in base for _ in range(30)]


def grown(sets, component=None):
    return J.SignatureTree(np.array([len(x) for x in sets]), [J.bitmap(x) for x in sets], component)


def test_tree_against_all_pairs():
    sets = many_sets()
    tree = grown(sets)
    assert len(tree.levels) >= 3
    found = {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for i, j in tree.candidates() for a, b in zip(i, j, strict=True)}
    near = {(j, i) for i in range(len(sets)) for j in range(i) if J.similar(sets[i], sets[j])}
    some = set(grown(sets).with_partner().tolist())
    assert {i for pair in near for i in pair} <= some == {i for pair in found for i in pair}
    assert near <= found and len(near) > 500 and len(found) < 0.05 * len(sets) ** 2


def test_links_of_a_tree_span_its_components():
    """By a traversal that components prune: far fewer pairs than similar ones, and none within a known component."""
    sets = many_sets()

    def closed(pairs, n=len(sets)):
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in pairs:
            root[find(i)] = find(j)
        return [min(j for j in range(n) if find(j) == find(i)) for i in range(n)]

    near = [(j, i) for i in range(len(sets)) for j in range(i) if J.similar(sets[i], sets[j])]
    links = grown(sets).links(sets)
    assert set(map(tuple, map(sorted, links))) <= set(near) and len(links) < len(sets)
    assert closed(links) == closed(near)
    known = np.array(closed(links[::2]))
    more = grown(sets, known).links(sets)
    assert closed(links[::2] + more) == closed(near) and all(known[i] != known[j] for i, j in more)


def test_partners():
    """No entry of a link is taken for one without a partner, and most others are."""
    draw = np.random.default_rng(7)
    tried = 0
    while tried < 300:
        n = int(draw.integers(1, 120))
        a = np.unique(draw.integers(0, 2**64, n, np.uint64))
        cut, more = int(draw.integers(0, max(1, n // 4))), int(draw.integers(0, max(1, n // 4)))
        b = np.unique(np.concatenate([draw.permutation(a)[cut:] if tried % 2 else a[cut:], draw.integers(0, 2**64 if tried % 3 else 2**58, more, np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        tried += 1
        sizes = np.array([len(a), len(b)])
        first = np.intersect1d(a, b)[0]
        place = np.array([np.searchsorted(a, first), np.searchsorted(b, first)])
        assert (place < J.prefix_length(sizes)).all()
        assert J.has_partner(np.zeros(2, np.int64), sizes, J.largest_partner(sizes, place)).all()
    n, run = np.array([600, 600, 600, 400, 600, 480, 600, 600]), np.array([0, 0, 1, 1, 2, 2, 3, 3])
    alone = J.has_partner(run, n, J.largest_partner(n, np.array([0, 66, 0, 0, 119, 0, 67, 0])))
    assert alone.tolist() == [True, True, False, False, True, True, False, True]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 100), (200, 200), (None, 7), (301, 300)] + [(500, 500 + i) for i in range(1, 80)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100, 300: 300, 301: 300} | {500 + i: 500 for i in range(80)}
    assert components(spark.createDataFrame(links, "a long, b long").limit(0)).count() == 0
