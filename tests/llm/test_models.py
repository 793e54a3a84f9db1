"""Quality, toxicity and language: held-out accuracy on the tables, and the parts against brute force."""

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pagelift.llm import langid, ngrams, quality, queries, toxicity

from .helpers import docs, empty, odd, text

SF = "/root/testdata/sf0.1"


def held_out(spark, name, labels, column):
    got = queries.QUERIES[name](spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/{labels}.parquet").select("doc_id", column), "doc_id").toPandas()
    return got


def test_quality_held_out(spark):
    got = held_out(spark, "op4_quality", "labels", "quality")
    assert len(got) > 500 and (got.predicted == got.quality).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    got = held_out(spark, "op2_toxicity", "labels", "toxic")
    found = got[got.toxic == 1].predicted.mean(), 1 - got[got.toxic == 0].predicted.mean()
    assert found[0] >= 0.9 and found[1] >= 0.99


def test_hidden_insults():
    """Held-out clean documents with one insult in another spelling, at one false alarm in a hundred."""
    docs_, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs_.merge(labels, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id])
    model = toxicity.fit(rows.text[~held].fillna("").tolist(), rows.toxic[~held].to_numpy(int))
    clean = rows.text[held & (rows.toxic == 0)].fillna("").tolist()
    alarms = model.scores(clean) >= 0.7
    assert alarms.mean() <= 0.01
    clean = [t for t, bad in zip(clean, alarms, strict=True) if not bad]
    draw = np.random.default_rng(8)
    letter = lambda: chr(97 + int(draw.integers(26)))

    def hidden(kind, w):
        k = int(draw.integers(1, len(w) - 1))
        if kind == "two letters put in":
            j = int(draw.integers(k, len(w)))
            return w[:k] + letter() + w[k:j] + letter() + w[j:]
        return {"plain": w, "a letter put in": w[:k] + letter() + w[k:], "signs": ".".join(w), "gaps": " ".join(w), "a letter replaced": w[:k] + "*" + w[k + 1 :]}[kind]

    least = {"plain": 0.99, "a letter put in": 0.9, "signs": 0.99, "gaps": 0.99, "a letter replaced": 0.75, "two letters put in": 0.45}
    words = ["trash", "idiot", "pathetic", "worthless", "scum", "loser", "stupid", "moron", "disgusting", "clown"]
    got = {kind: float((model.scores([clean[int(draw.integers(len(clean)))] + " " + hidden(kind, w) for w in words for _ in range(20)]) >= 0.7).mean()) for kind in least}
    assert all(got[kind] >= least[kind] for kind in least), got


def test_language_held_out(spark):
    got = held_out(spark, "op5_langid", "documents", "lang")
    assert (got.lang_pred == got.lang).mean() > 0.99


def brute_statistics(t):
    t = t or ""
    w = t.lower().split() if t.isascii() else None
    lines = [x for x in t.split("\n") if x]
    return {"log_bytes": np.log1p(len(t.encode())), "log_words": np.log1p(len(w)), "distinct_words": len(set(w)) / len(w) if w else 0, "top_word": max(map(w.count, w)) / len(w) if w else 0, "repeats": sum(a == b for a, b in itertools.pairwise(w)) / len(w) if w else 0, "distinct_lines": len(set(lines)) / len(lines) if lines else 0, "exclaim": t.count("!") / max(1, len(t)), "upper": sum(c.isupper() for c in t) / max(1, len(t)), "long_words": 0 if not w else None}


def test_statistics():
    texts = ["", None, "a A a b!", "x y\nx y\nz", " ", "Of Of Of the the\n\nend!!", "ONE TWO"]
    got = quality.statistics(pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        for k, v in brute_statistics(t).items():
            if v is not None:
                assert row[quality.FEATURES.index(k)] == pytest.approx(v), (t, k)


def test_rules_in_spark_and_numpy_agree(spark):
    draw = np.random.default_rng(1)
    x = draw.random((800, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4) | (x[:, 5] > 0.9)).astype(float)
    model = quality.fit(x, y)
    p = model.predict(x)
    assert ((p > 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 200
    table = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{f} double" for f in quality.FEATURES))
    assert np.allclose([r[0] for r in table.select(model.column()).collect()], p)
    assert quality.fit(x[:5], np.ones(5)).predict(x[:2]) == pytest.approx(6 / 7) and quality.fit(x[:0], y[:0]).predict(x[:1]) == pytest.approx(0.5)


def brute_kernel(a, b):
    """All subsequences of the orders, by definition."""

    def features(w):
        w = "\x02" + w + "\x03"
        out, norm = {}, 0.0
        for p in toxicity.ORDERS:
            for places in itertools.combinations(range(len(w)), p):
                span = places[-1] - places[0] + 1
                if span <= toxicity.SPAN:
                    weight = toxicity.DECAY ** (span - p)
                    out[tuple(w[i] for i in places)] = out.get(tuple(w[i] for i in places), 0) + weight
                    norm += weight**2
        return {k: v / norm**0.5 for k, v in out.items()}

    x, y = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_against_its_definition():
    words = ["idiot", "idxiot", "ab", "aaaa", "übel", "trash", "crash"]
    got = toxicity.kernel(words, words)
    want = [[brute_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-3)
    assert got[0][1] > 0.4 > got[0][5]


def test_table_equals_the_sum_over_landmarks():
    clean = [text(i, 30) for i in range(300)]
    model = toxicity.fit(clean + [f"{text(1000 + i, 20)} idiot {text(2000 + i, 5)} moron" for i in range(60)], np.array([0] * 300 + [1] * 60))
    scores = model.scores(["you idiot", "i.d.i.o.t here", "an i d i o t", "idiiot", "1d1ot", text(5, 30), "", "the morons of"])
    assert (scores[:5] > 0.7).all() and (scores[5:7] < 0.3).all()


def test_units():
    assert toxicity.units("St-upid, 1d10t! a b c d") == ["stupid", "idiot", "a", "b", "c", "d", "abcd"]


def test_no_labels(spark):
    model = toxicity.fit([], np.zeros(0, int))
    assert [r["score"] for r in toxicity.score(docs(spark, ["a"]), model).collect()] == [0.0]
    assert toxicity.fit(["a b c d e"] * 4, np.array([1, 1, 0, 0])).scores(["x"]) == [0.5]


def sequence_probabilities(e, start, move):
    """Marginals over all label sequences, one by one."""
    n, k = e.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        s = np.exp(start[labels[0]] + sum(e[i, y] for i, y in enumerate(labels)) + sum(move[a, b] for a, b in itertools.pairwise(labels)))
        for i, y in enumerate(labels):
            out[i, y] += s
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_against_all_sequences():
    draw = np.random.default_rng(2)
    lengths = np.array([1, 5, 3, 4])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    e, start, move = draw.normal(size=(13, 3)), draw.normal(size=3), draw.normal(size=(3, 3))
    p, moves, starts = langid.forward_backward(e, first, lengths, start, move)
    want = np.concatenate([sequence_probabilities(e[a : a + n], start, move) for a, n in zip(first, lengths, strict=True)])
    assert np.allclose(p, want) and moves.sum() == pytest.approx(9) and np.allclose(starts, want[first].sum(axis=0))


@pytest.mark.parametrize("languages", [1, 3])
def test_whole_chains(languages):
    """Chains of many links have the probabilities that one pass over all their words gives."""
    draw = np.random.default_rng(6)
    lengths = np.array([1, 63, 64, 65, 128, 129, 1000, 7, 300])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    e, start, move = 0.3 * draw.normal(size=(lengths.sum(), languages)), draw.normal(size=languages), 2 * draw.normal(size=(languages, languages))
    want = langid.forward_backward(e, first, lengths, start, move)[0]
    assert np.allclose(langid.marginals(e, first, lengths, start, move), want)


def test_code_switched_text():
    draw = np.random.default_rng(3)
    make = lambda syllables: " ".join("".join(draw.choice(syllables, 3)) for _ in range(40))
    kinds = {"a": ["ka", "ro", "mi"], "b": ["sch", "tz", "ei"]}
    texts, langs = zip(*[(make(s), k) for k, s in kinds.items() for _ in range(60)], strict=True)
    model = langid.fit(list(texts), list(langs))
    words = langid.Words.of_texts(pa.array(["karomi rokami " * 5 + "schtzei tzeisch " * 5]))
    labels = model.marginals(words).argmax(axis=1)
    assert labels.tolist() == [0] * 10 + [1] * 10 and (np.diag(model.move) > 0).all()
    assert model.predict(pa.array([None, "", "12 !", "“—”", "karomi"]))[0] == ["und"] * 4 + ["a"]


def test_whole_runs_of_letters_count():
    draw = np.random.default_rng(4)
    make = lambda letters, n: "".join(draw.choice(list(letters), n))
    kinds = {"x": "天地人山水火木金土日", "y": "あいうえおかきくけこ"}
    texts, langs = zip(*[(make(s, 60), k) for k, s in kinds.items() for _ in range(60)], strict=True)
    model = langid.fit(list(texts), list(langs))
    turned = make(kinds["x"], 10) + make(kinds["y"], 80)
    assert model.predict(pa.array([turned, make(kinds["x"], 80) + make(kinds["y"], 10)]))[0] == ["y", "x"]
    assert set(model.marginals(langid.Words.of_texts(pa.array([turned]))).argmax(axis=1)) == {0, 1}
    split = langid.Words.of_texts(pa.array(["天地。天地、「天地」", "天地 天地 天地", "«über»—¿über？"]))
    assert split.of.tolist() == [0, 0, 0, 1, 1, 1, 2, 2] and len(set(split.number[:6])) == 1 and split.number[6] == split.number[7]


def test_words_learned_from_are_a_parameter():
    texts, langs = ["ka ro mi " * 20, "sch tz ei " * 20], ["a", "b"]
    few, all_ = langid.fit(texts, langs, rounds=1, most_words=16), langid.fit(texts, langs, rounds=1)
    assert (few.weights != 0).any(axis=1).sum() < (all_.weights != 0).any(axis=1).sum() or not np.allclose(few.weights, all_.weights)


def test_every_language_is_learned(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, langs, **given: seen.update(langs=set(langs), **given))
    monkeypatch.setattr(langid.samples, "learned", lambda sample, of: of(sample))
    rows = spark.createDataFrame([(i, f"text {i}", f"l{i:02}") for i in range(70)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid.samples, "labelled_texts", lambda docs, labels, column, most: docs.toPandas().rename(columns={"lang": "label_"}).query("label_ in @most"))
    langid.train(rows, most_words=9)
    assert len(seen["langs"]) == 70 and seen["most_words"] == 9


def test_pieces_have_all_n_grams():
    for run in ["天地人山水火木金土日" * 3, "достопримечательность", "x" * 17, "aé天😀" * 9, "a" * 16, "abcdefghijklmnopqrstuvwxyz" * 2]:
        low = np.frombuffer(run.encode(), np.uint8)
        none = np.zeros(1, np.int64)
        hashes, starts, lengths, of = langid.pieces(low, none.astype(np.uint64), none, np.array([len(low)]), none)
        assert lengths.max() <= langid.MOST_BYTES and len(hashes) == len(of) and all(low[starts] & 0xC0 != 0x80)
        had = {(a + i) for a, n in zip(starts, lengths, strict=True) for i in range(n - 2)}
        assert had == set(range(len(low) - 2)) and (starts[-1] + lengths[-1]) == len(low)


@pytest.mark.parametrize("name, columns", [("op2", {"doc_id", "score"}), ("op4", {"doc_id", "score"}), ("op5", {"doc_id", "lang_pred", "score"})])
def test_odd_rows(spark, name, columns):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    for rows in (odd(spark), empty(spark)):
        if name == "op2":
            got = toxicity.score(rows, toxicity.train(rows, labels))
        elif name == "op4":
            got = quality.score(rows, labels)
        else:
            got = langid.identify(rows, langid.train(rows))
        assert set(got.columns) == columns and got.count() == rows.count()
        assert got.filter("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.drop_toxic(odd(spark), toxicity.fit([], np.zeros(0, int)))
    assert kept.columns == odd(spark).columns and kept.count() == odd(spark).count()


def test_hashes_of_words_and_shingles():
    texts = ["A b", "a B", "a  b", "ab", None, "", "a b c d e f", "x y z w v", "x y z w v u"]
    sets = ngrams.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 0, 2, 1, 2]
    assert (sets[0] == sets[1]).all() and (sets[0] == sets[2]).all() and sets[0] != sets[3] and sets[7][0] in sets[8]
    part = pa.array(["zz", "a b", None, "a b"]).slice(1)
    assert [len(s) for s in ngrams.shingle_sets(part)] == [1, 0, 1]


def test_long_words_are_cut_so_that_insults_stay_whole():
    from pagelift.llm import toxicity

    for length in range(25, 80):
        word = "".join(chr(0x4E00 + i) for i in range(length))
        windows, _ = toxicity._cut([word])
        for at in range(length - 15):
            assert any(word[at : at + 16] in w for w in windows)
