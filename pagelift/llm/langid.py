"""Language identification by a linear-chain conditional random field over words.

A word's emission scores sum hashed weights of its affixes, its letter n-grams and itself (the lexicon); transitions
between the labels of neighbouring words are learned, too, from chains that are put together of runs in different
languages. Forward-backward gives each word's label probabilities, so texts that switch languages are labelled word
by word; a document's language is that with the largest sum. A whole document is one chain; forward-backward goes over it
in steps of constant size, so that long documents cost no more a word than short ones.

Words are runs of letters and marks of any script. A run of more than MOST_BYTES bytes (scripts without spaces, long
words) is cut into consecutive pieces, each a word of the chain, that overlap by two bytes, so that no n-gram is lost.
Learning is on a bounded sample of whole documents.

Defined cases: a text that is null, empty or without any letter is `und` with score 0. If nothing is learned (no
labelled rows) every text is `und`. With one language all others get it. Repeated rows have a row each, an empty table
none. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams, samples
from .runtime import slices, small_batches, text_or_empty

#: Most documents of each language that are learned from, and most words of all of them, in runs of RUN; every language
#: is learned (1 MB of the model each).
SAMPLE_ROWS, SAMPLE_WORDS, RUN = 400, 150_000, 8
#: Words of a chain that is learned from, and of a link of the chain of a whole text.
CHAIN = 64
#: Bytes of texts that are labelled at a time, for each language (of one more matrix each).
LABELLED = 8 << 20
TABLE_BITS = 18
#: Letters at either end that make affixes, lengths of n-grams, most of a word, and a piece's step, in bytes: a piece may
#: begin three bytes early, at a character, and reach into the next as far as an n-gram does.
AFFIX, GRAMS, MOST_BYTES = 4, (2, 3), 16
PIECE = MOST_BYTES - 3 - (max(GRAMS) - 1)

_bytes = np.arange(256)
_NOT_LETTER = ~(((_bytes >= 65) & (_bytes < 91)) | ((_bytes >= 97) & (_bytes < 123)) | (_bytes > 127))
# Characters that are no letters or marks; the joiners U+200C and U+200D stand inside words.
_APART = np.array([unicodedata.category(chr(c))[0] not in "LM" and c not in (0x200C, 0x200D) for c in range(1 << 16)])
_random = np.random.Generator(np.random.PCG64(7))
_BYTE = _random.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_SALT = _random.integers(0, 2**64, 32, np.uint64)


def fold(body: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capital Latin-1 letters in UTF-8."""
    out = body.copy()
    out[(body >= 65) & (body < 91)] += 32
    if len(body) > 1:
        second = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
        out[1:][second] += 32
    return out


def blank(low: np.ndarray) -> None:
    """Write spaces over the signs beyond ASCII, in place."""
    high = np.flatnonzero(low >= 0xC2)
    for size, least, most in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = high[(low[high] >= least) & (low[high] < most) & (high + size <= len(low))]
        code = low[at].astype(np.int64) & (0xFF >> (size + 1))
        for j in range(1, size):
            code = code << 6 | low[at + j] & 63
        sign = _APART[code] if size < 4 else (code >= 0x1F000) & (code < 0x1FC00)  # pictures
        for j in range(size):
            low[at[sign] + j] = 32


def pieces(low: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with those of more than MOST_BYTES bytes cut into pieces that begin with a character."""
    n = np.where(lengths > MOST_BYTES, (lengths - max(GRAMS)) // PIECE + 1, 1)
    if n.max(initial=1) == 1:
        return hashes, starts, lengths, of
    word = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[word] + step * PIECE
    for _ in range(3):
        begin -= (step > 0) & (low[begin] & 0xC0 == 0x80)
    end = (starts + lengths)[word]
    more = np.flatnonzero(step < n[word] - 1)
    end[more] = begin[more + 1] + max(GRAMS) - 1
    size, out = end - begin, hashes[word]
    cut = np.flatnonzero(n[word] > 1)
    place = np.arange(MOST_BYTES)
    codes = ngrams._BYTE[low[np.minimum(begin[cut, None] + place, len(low) - 1)]] * ngrams._power(MOST_BYTES)[place]
    out[cut] = ngrams.mix(np.where(place < size[cut, None], codes, np.uint64(0)).sum(axis=1))
    return out, begin, size, of[word]


def word_features(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the weight table of each word's features, a column each; a missing feature has place 0."""
    n, size = len(starts), np.minimum(lengths, MOST_BYTES)
    columns = np.arange(MOST_BYTES)
    there = columns[None, :] < size[:, None]
    codes = np.where(there, _BYTE[body[np.minimum(starts[:, None] + columns[None, :], max(len(body) - 1, 0))]], np.uint64(0))
    tail_at = starts + lengths
    tail = np.where(np.arange(1, AFFIX + 1)[None, :] <= size[:, None], _BYTE[body[np.maximum(tail_at[:, None] - np.arange(1, AFFIX + 1)[None, :], 0)]], np.uint64(0))
    out, kind = [], 0

    def add(value: np.ndarray, ok: np.ndarray) -> None:
        nonlocal kind
        found = (ngrams.mix(value + _SALT[kind]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out.append(np.where(ok, np.maximum(found, 1), 0))
        kind += 1

    add(hashes, np.ones(n, bool))
    for part, letters in (("head", codes), ("tail", tail)):
        total = np.zeros(n, np.uint64)
        for k in range(AFFIX):
            total = total * np.uint64(0x9E3779B97F4A7C15) + letters[:, k]
            add(total, size > k if part == "head" else size >= k + 1)
    for gram in GRAMS:
        total = np.zeros((n, MOST_BYTES - gram + 1), np.uint64)
        for j in range(gram):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[:, j : MOST_BYTES - gram + 1 + j]
        found = (ngrams.mix(total + _SALT[20 + gram]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        ok = there[:, gram - 1 :]
        out += list(np.where(ok, np.maximum(found, 1), 0).T)
    return np.stack(out)


@dataclass
class Words:
    """The words of some texts: the text of each, its place among the different words, and those words' features."""

    of: np.ndarray
    number: np.ndarray
    features: np.ndarray
    texts: int

    @classmethod
    def of_texts(cls, texts: pa.Array) -> Words:
        body, offsets = ngrams.buffers(texts)
        low = fold(body)
        blank(low)
        hashes, starts, of = ngrams.words(low, offsets, _NOT_LETTER, fold=False)
        if not len(hashes):
            return cls(of, of, np.zeros((1, 0), np.int64), len(offsets) - 1)
        stop = np.concatenate([~_NOT_LETTER[low], [False]])
        stop[offsets] = False  # a word ends with its text
        ends = np.flatnonzero(~stop)
        hashes, starts, lengths, of = pieces(low, hashes, starts, ends[np.searchsorted(ends, starts + 1)] - starts, of)
        kinds, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        return cls(of, number, word_features(low, starts[first], lengths[first], kinds), len(offsets) - 1)


def chains(of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain: the words of a text."""
    counts = np.bincount(of, minlength=texts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return first[counts > 0], counts[counts > 0]


def links_between(e: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chains in links of CHAIN words: first word and length of each link, the messages that come into it from either
    side, and whether it begins a chain. Those that pass through a link are a product of matrices, for all links at
    once; only links, not words, are gone through one after another."""
    labels, n = len(start), -(-length // CHAIN)
    chain = np.repeat(np.arange(len(first)), n)
    step = np.arange(len(chain)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[chain] + step * CHAIN
    size = np.minimum(CHAIN, first[chain] + length[chain] - begin)
    forward, back = np.tile(np.exp(start), (len(chain), 1)), np.ones((len(chain), labels))
    many = np.flatnonzero(n[chain] > 1)
    if len(many):
        through = np.tile(np.eye(labels), (len(many), 1, 1))
        for t in range(CHAIN):
            live = np.flatnonzero(size[many] > t)
            now = (through[live] @ m) * e[begin[many[live]] + t][:, None, :]
            through[live] = now / now.sum(axis=(1, 2), keepdims=True)
        place = np.zeros(len(chain), np.int64)
        place[many] = np.arange(len(many))
        # The first link has no move before it: its messages are those of its words alone.
        heads = many[step[many] == 0]
        out = np.zeros((len(chain), labels))
        a = np.exp(start) * e[begin[heads]]
        for t in range(1, CHAIN):
            a = (a @ m) * e[begin[heads] + t]
            a /= a.sum(axis=1, keepdims=True)
        out[heads] = a
        last = int(n.max())
        of_step = [many[step[many] == k] for k in range(last)]
        for k in range(1, last):
            own = of_step[k]
            forward[own] = out[own - 1]
            a = np.einsum("ni,nij->nj", forward[own], through[place[own]])
            out[own] = a / a.sum(axis=1, keepdims=True)
        for k in range(last - 1, 0, -1):
            own = of_step[k]
            b = np.einsum("nij,nj->ni", through[place[own]], back[own])
            back[own - 1] = b / b.sum(axis=1, keepdims=True)
    return begin, size, forward, back, step == 0


def marginals(emission: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Label probabilities of each word by forward-backward over whole chains of any length."""
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    m = np.exp(move)
    begin, size, forward, back, head = links_between(e, first, length, start, m)
    order = np.argsort(-size, kind="stable")
    begin, size, forward, back, head = (x[order] for x in (begin, size, forward, back, head))
    running = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max(initial=0)))]
    a, b = np.zeros_like(e), np.ones_like(e)
    b[begin + size - 1] = back
    for t, live in enumerate(running):
        at = begin[:live] + t
        now = (np.where(head[:, None], forward, forward @ m) if t == 0 else a[at - 1] @ m) * e[at]
        a[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(running) - 1, 0, -1):
        at = begin[: running[t]] + t
        past = (e[at] * b[at]) @ m.T
        b[at - 1] = past / past.sum(axis=1, keepdims=True)
    p = a * b
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def forward_backward(emission: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of each word, expected moves, and expected first labels, over all chains at once.

    emission: scores of each word (a row each); chains are consecutive words.
    """
    n, labels = emission.shape
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    running = np.array([np.searchsorted(-length, -t, "left") for t in range(int(length.max(initial=0)))])  # chains longer than t
    top = emission.max(axis=1, keepdims=True)
    e = np.exp(emission - top)
    a, b = np.zeros((n, labels)), np.ones((n, labels))
    m = np.exp(move)
    moves, starts = np.zeros((labels, labels)), np.zeros(labels)
    for t, live in enumerate(running):
        at = first[:live] + t
        now = np.exp(start) * e[at] if t == 0 else (a[at - 1] @ m) * e[at]
        a[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(running) - 1, 0, -1):
        at = first[: running[t]] + t
        after = e[at] * b[at]
        back = after @ m.T
        b[at - 1] = back / back.sum(axis=1, keepdims=True)
        pair = a[at - 1][:, :, None] * m[None] * after[:, None, :]
        moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = a * b
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    if len(first):
        starts = p[first].sum(axis=0)
    return p, moves, starts


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # a row for each place of the table
    start: np.ndarray
    move: np.ndarray

    def marginals(self, words: Words) -> np.ndarray:
        """Label probabilities of each word."""
        scores = np.zeros((words.features.shape[1], len(self.languages)), self.weights.dtype)
        for places in words.features:
            scores += self.weights.take(places, axis=0)
        return marginals(scores[words.number].astype(float), *chains(words.of, words.texts), self.start, self.move)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words = Words.of_texts(texts)
        total = np.zeros((words.texts, max(1, len(self.languages))))
        if len(words.of) and self.languages:
            p = self.marginals(words)
            for k in range(len(self.languages)):
                total[:, k] = np.bincount(words.of, p[:, k], minlength=words.texts)
        counts = np.bincount(words.of, minlength=words.texts) if len(words.of) else np.zeros(words.texts)
        best, score = total.argmax(axis=1), total.max(axis=1) / np.maximum(counts, 1)
        names = [self.languages[b] if c and self.languages else "und" for b, c in zip(best, counts, strict=True)]
        score = np.where(counts > 0, np.clip(score, 0, 1), 0.0)
        body, offsets = ngrams.buffers(texts)
        ascii_letters = np.concatenate([[0], np.cumsum(~_NOT_LETTER[body] & (body < 128))])
        doubtful = np.flatnonzero((counts > 0) & (ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]))
        for i in doubtful:  # signs beyond ASCII that are no letters
            if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
                names[i], score[i] = "und", 0.0
        return names, score


def fit(texts: list[str], languages: list[str], rounds: int = 40, rate: float = 0.3, ridge: float = 1e-5, most_words: int = SAMPLE_WORDS) -> LanguageModel:
    """Conditional likelihood by adaptive gradient steps over all chains of at most most_words words, in runs of RUN drawn
    from all documents."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], np.int64)
    size = len(names)
    model = LanguageModel(names, np.zeros((1 << TABLE_BITS, size)), np.zeros(size), np.zeros((size, size)))
    words = Words.of_texts(pa.array(texts, pa.large_string()))
    if size == 0 or not len(words.of):
        return LanguageModel([], model.weights, model.start, model.move)
    draw = np.random.Generator(np.random.PCG64(1))
    runs = np.arange(0, len(words.of), RUN)
    runs = np.sort(draw.permutation(runs)[: most_words // RUN])
    keep = (runs[:, None] + np.arange(RUN)[None, :]).ravel()
    keep = keep[keep < len(words.of)]
    # Half the runs stay in order, so that chains have one language; the others are dealt anew, so that chains switch.
    groups = np.array_split(keep, max(1, len(runs)))
    half = len(groups) // 2
    mixed = [groups[i] for i in half + draw.permutation(len(groups) - half)]
    order = np.concatenate([*groups[:half], *mixed]) if groups else keep
    number, y = words.number[order], label[words.of[order]]
    used, number = np.unique(number, return_inverse=True)
    features = np.ascontiguousarray(words.features[:, used])
    n = len(number)
    first = np.arange(0, n, CHAIN)
    length = np.minimum(CHAIN, n - first)
    squares = np.full_like(model.weights, 1e-3)
    square_move, square_start = np.full((size, size), 1e-3), np.full(size, 1e-3)
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen_moves = np.zeros((size, size))
    np.add.at(seen_moves, (y[at - 1], y[at]), 1)
    seen_starts = np.bincount(y[first], minlength=size)
    for _ in range(rounds):
        scores = np.zeros((features.shape[1], size))
        for places in features:
            scores += model.weights.take(places, axis=0)
        p, moves, starts = forward_backward(scores[number], first, length, model.start, model.move)
        p[np.arange(n), y] -= 1
        own = np.stack([np.bincount(number, p[:, k], minlength=features.shape[1]) for k in range(size)], axis=1)
        grad = ridge * n * model.weights
        flat = features.ravel()
        for k in range(size):
            grad[:, k] += np.bincount(flat, np.tile(own[:, k], len(features)), minlength=len(grad))
        grad[0] = 0
        for value, square, g in ((model.weights, squares, grad / n), (model.move, square_move, (moves - seen_moves) / n), (model.start, square_start, (starts - seen_starts) / n)):
            square *= 0.9
            square += 0.1 * g**2
            value -= rate * g / np.sqrt(square)
        rate *= 0.95
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", rows: int = SAMPLE_ROWS, most_words: int = SAMPLE_WORDS) -> LanguageModel:
    """Learn all languages from at most rows documents of each, and most_words words; docs: those that may be learned from."""
    labels = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang")).filter("lang is not null")
    names = [r["lang"] for r in labels.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()]
    if not names:
        return fit([], [])

    def of(sample: pd.DataFrame) -> LanguageModel:
        sample = samples.one_each(sample)
        return fit(sample["text"].tolist(), sample["label_"].tolist(), most_words=most_words)

    return samples.learned(samples.labelled_texts(docs, labels, "lang", dict.fromkeys(names, rows)), of)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, min(2 << 20, LABELLED // max(1, len(sent.value.languages)))):
                names, score = sent.value.predict(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(score.astype(float))], names=["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
