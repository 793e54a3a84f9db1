import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelift.llm import packing

from .helpers import docs, empty, odd, text

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def check(rows, pieces, whole, sequence=4096):
    """Each id in one piece, sequences gapless; returns the share of padding."""
    ids = defaultdict(list)
    for r in rows:
        ids[r["doc_id"]].append(np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4"))
    by, used = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, own in ids.items():
        assert sum(p["length"] for p in by[i]) == sum(map(len, own))
        want = sorted(len(o) for o in own)
        assert sorted({p["doc_tokens"] for p in by[i]}) == sorted(set(want))
        if len(own) == 1:
            at = 0
            for p in sorted(by[i], key=lambda p: p["start"]):
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(own[0][at : at + p["length"]].tobytes())
                at += p["length"]
    total = padding = 0
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= sequence
        total += at
        padding += 0 if at & (at - 1) == 0 else sequence - at
    return padding / (total + padding)


def test_packs_all(spark, sf, whole):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    assert check(rows.collect(), packing.pack(rows, PATH).collect(), whole) < 0.001


def test_many_short_texts(spark, whole, monkeypatch):
    """Most are placed by patterns, in several tasks, and little padding is left."""
    monkeypatch.setattr(packing, "FILL_TOKENS", 1 << 14)
    rows = spark.range(1, 12_001).selectExpr("id AS doc_id", "concat('note ', id % 7, ' says ', id % 11, ' of it') AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    pieces = packing.pack(rows, PATH).collect()
    assert check(rows.collect(), pieces, whole) < 0.01
    share = packing.filler_share(8, 16)
    assert share < 0.6 and packing.filler_share(1000, 16) < 0.07


def test_other_rules_go_to_the_library(tmp_path):
    import json

    rules = json.load(open(PATH))
    rules["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}]}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(rules))
    for path, followed in ((PATH, True), (str(other), False)):
        tok, lib = packing.WordTokenizer(str(path)), Tokenizer.from_file(str(path))
        assert tok.followed is followed
        for t in ("Some Words, here 12", "x" * 500, "É ß"):
            assert tok.ids(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_odd_rows(spark, whole):
    rows = odd(spark)
    check(rows.collect(), packing.pack(rows, PATH).collect(), whole)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_short_copies(spark, whole):
    rows = docs(spark, [text(1, 6)] * 900 + [text(i, 200) for i in range(40)])
    assert check(rows.collect(), packing.pack(rows, PATH).collect(), whole) < 0.001


@pytest.mark.parametrize("value", ["It's the dog's 3.14 e-mail, don't!", "Über ÉCOLE ñandú ß ÿ Œuvre", "日本語 и русский text", "a\u0000b \x85 \xa0 x y", "é combining", "<|endoftext|> x <|startoftext|>", "İstanbul ŉ ſ Ǆ", "x" * 3000, "²³¹¼ 1² a1b2", "", " \n\t ", "'s 't're'VE 'LLx", "😀😀 emoji", "tab\there\x0bvt\x0cff"])
def test_ids_equal_the_library(whole, value):
    assert np.frombuffer(packing.tokenizer(PATH).ids(value), "<u4").tolist() == whole.encode(value, add_special_tokens=False).ids


def test_memory_is_bounded():
    tok = packing.WordTokenizer(PATH)
    tok.KEPT = 50
    first = tok.ids(text(1, 500))
    assert len(tok.new) <= 51 and len(tok.old) <= 51 and tok.ids(text(1, 500)) == first


def test_knapsack_against_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.unique(draw.integers(1, 12, 5))
        values = draw.random(len(sizes))
        best = np.zeros(21)
        for room in range(1, 21):
            best[room] = max([best[room - 1], *(values[k] + best[room - s] for k, s in enumerate(sizes) if s <= room)])
        value, counts = packing.price(values, sizes, 20)
        assert value == pytest.approx(best[20]) == pytest.approx(float(counts @ values)) and counts @ sizes <= 20


def test_patterns_use_all_and_come_near_the_bound():
    draw = np.random.default_rng(5)
    histogram = {int(s): int(draw.integers(1, 400)) for s in draw.permutation(np.arange(1, 257))[:60]}
    found, used = packing.patterns(histogram), defaultdict(int)
    for counts, times in found:
        assert sum(s * c for s, c in counts.items()) <= 256 and times > 0
        for s, c in counts.items():
            used[s] += c * times
    assert dict(used) == histogram
    bound = -(-sum(s * n for s, n in histogram.items()) // 256)
    assert sum(t for _, t in found) <= 1.03 * bound + 60
    assert packing.patterns({}) == [] and packing.patterns({256: 3}) == [({256: 1}, 3)]


def all_patterns(sizes, capacity):
    if not len(sizes):
        yield ()
        return
    for n in range(capacity // sizes[0] + 1):
        for rest in all_patterns(sizes[1:], capacity - n * sizes[0]):
            yield (n, *rest)


@pytest.mark.parametrize("seed", range(12))
def test_the_linear_program_is_at_its_optimum(seed):
    """Its value is that of its dual, and no pattern of all that there are is worth more than a sequence."""
    draw = np.random.default_rng(seed)
    capacity = int(draw.integers(8, 25))
    sizes = np.unique(draw.integers(1, capacity + 1, 6))[::-1]
    demand = draw.integers(1, 10 ** int(draw.integers(1, 7)), len(sizes)).astype(float)
    found, use = packing.column_generation(sizes, demand, capacity)
    assert (found @ sizes <= capacity).all() and (use >= 0).all() and found.T @ use == pytest.approx(demand)
    dual = np.linalg.solve(found.astype(float), np.ones(len(sizes)))
    assert (dual >= -1e-9).all() and dual @ demand == pytest.approx(use.sum())
    assert max(np.array(p) @ dual for p in all_patterns(sizes, capacity)) <= 1 + 1e-6


def test_the_basis_is_inverted_anew(monkeypatch):
    draw = np.random.default_rng(8)
    sizes, demand = np.arange(256, 4, -4), draw.integers(1, 5000, 63).astype(float)
    values = []
    for steps in (3, 50, 10**9):
        monkeypatch.setattr(packing, "REPLACED", steps)
        found, use = packing.column_generation(sizes, demand, 256)
        assert found.T @ use == pytest.approx(demand)
        values.append(use.sum())
    assert values[0] == pytest.approx(values[1]) == pytest.approx(values[2])


def test_powers():
    assert packing._power_parts(1000) == [512, 256, 128, 64, 32, 8]
