"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel of two words sums, over all subsequences of ORDERS letters within SPAN letters, DECAY to the gaps of both
occurrences: a word with letters put in between still shares most subsequences with the word it hides. A word is set
between two marks, so that beginnings and ends count. Nyström landmarks (insults and hard clean words) span the
machine's function; as the kernel has an explicit map, the landmarks' weights are summed once into a table over
hashed subsequences, and a word's value is a sum over its own subsequences, equal to that over the landmarks.

Labels are of documents: words found far more often in toxic ones than chance explains are the positive instances.
A document is judged by its WORST worst words: each has a probability to be an insult, and the document one that any
of them is, so that one clear insult counts, and several words that are each less clear do, too. Signs inside words are
taken out, digits that stand for letters are read as such, and letters set apart by single spaces are joined.

Defined cases: null text is empty; an empty text has the score of a text without any known word. Without labelled rows
of both kinds, or without a word that tells them apart, every score is the share of label 1 (0 without any label).
Repeated rows have a row each, an empty table none. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams, samples
from .runtime import give_back, slices, small_batches, text_or_empty

#: Most labelled documents that are learned from.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 6000
ORDERS, SPAN, DECAY = (3, 4, 5), 6, 0.8
#: Words are cut into windows of so many letters, each beginning so many after the last: any 16 letters are whole in one.
WINDOW, STEP = 24, 8
#: Words of a document that count, and the values that count as the least and most.
WORST, LOW, HIGH = 6, -3.0, 1.5
TABLE_BITS = 20
#: Bounds of the fit: landmarks, spellings in all, clean words of each turn, and turns. Insults are as many as the sample has.
LANDMARKS, SPELLINGS, HARD, TURNS = 600, 2400, 1000, 5
#: Letters of the shortest word that is learned in other spellings.
LEAST_HIDDEN = 4
#: What all spellings of a word count, against the word itself, and what a clean word counts for each document.
HIDDEN_COST, CLEAN_COST = 2.0, 60.0
#: What a clean document counts in calibration, against a toxic one.
FALSE_ALARM = 3.0
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

_random = np.random.Generator(np.random.PCG64(2))
_LETTER = _random.integers(0, 2**32, 4096, np.uint32) | np.uint32(1)
_ROLE = _random.integers(0, 2**32, max(ORDERS) + 1, np.uint32) | np.uint32(1)
_SHAPES = [(0, *rest) for p in ORDERS for rest in itertools.combinations(range(1, SPAN), p - 1)]
_SIGNS = re.compile(r"[^\w\s]|_")
_APART = re.compile(r"(?<!\S)(?:\w\s){2,}\w(?!\S)")
# Digits that stand for letters.
_DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
_HAS_DIGIT = re.compile("[013457]")


def units(text: str) -> list[str]:
    """The words of a text as they are read aloud: without signs, digits as letters, spaced letters joined."""
    plain = _SIGNS.sub("", text.lower())
    if _HAS_DIGIT.search(plain):
        plain = plain.translate(_DIGITS)
    found = plain.split()
    if b"\1\1\1" in bytes([len(w) == 1 for w in found]):
        found += ["".join(m.group().split()) for m in _APART.finditer(plain)]
    return found


def _cut(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Marked windows of words, and the word of each."""
    out, of = [], []
    for i, w in enumerate(words):
        for at in range(0, max(1, len(w) - WINDOW + STEP), STEP) if len(w) > WINDOW else (0,):
            out.append(("\x02" if at == 0 else "") + w[at : at + WINDOW] + ("\x03" if at + WINDOW >= len(w) else ""))
            of.append(i)
    return out, np.array(of, np.int64)


def _codes(windows: list[str], length: int) -> np.ndarray:
    flat = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32)
    return _LETTER[flat & np.uint32(4095)].reshape(len(windows), length)


def _each(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Hashed subsequence and weight of each place of each shape, one vector over the windows at a time."""
    length = codes.shape[1]
    by_role = [np.ascontiguousarray((codes * r).T) for r in _ROLE]
    for shape in _SHAPES:
        weight = DECAY ** (shape[-1] + 1 - len(shape))
        first = by_role[0] + _ROLE[len(shape)]
        for at in range(length - shape[-1]):
            total = first[at]
            for role, step in enumerate(shape[1:], 1):
                total = total + by_role[role][at + step]
            yield total >> np.uint32(32 - TABLE_BITS), weight


def _norm(length: int) -> float:
    """The root of the sum of squared weights of a window of so many letters."""
    return math.sqrt(sum(DECAY ** (2 * (s[-1] + 1 - len(s))) * max(0, length - s[-1]) for s in _SHAPES) or 1.0)


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The normalised explicit map of each word's first window, words of one length together: their places among
    words, the hashed subsequences (a row each) and their weights."""
    windows, of = _cut(words)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    lengths = np.array([len(windows[i]) for i in first])
    out = []
    for length in np.unique(lengths):
        rows = first[lengths == length]
        found = list(_each(_codes([windows[i] for i in rows], int(length))))
        if found:
            out.append((of[rows], np.stack([x for x, _ in found], axis=1), np.array([w for _, w in found], np.float32) / np.float32(_norm(int(length)))))
    return out


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """The kernel of each word with each other, a block of others at a time."""
    out = np.zeros((len(words), len(others)), np.float32)
    own = features(words)
    for begin in range(0, len(others), 64):
        maps = features(others[begin : begin + 64])
        used = np.unique(np.concatenate([x.ravel() for _, x, _ in maps])) if maps else np.zeros(0, np.uint32)
        place = np.full(1 << TABLE_BITS, len(used), np.int32)
        place[used] = np.arange(len(used))
        dense = np.zeros((len(used) + 1, len(others[begin : begin + 64])), np.float32)  # the last row is of subsequences that no other has
        for who, index, weight in maps:
            np.add.at(dense, (place[index], who[:, None]), weight[None, :])
        for who, index, weight in own:
            for k in range(0, len(who), 256):
                found = place[index[k : k + 256]]
                some = np.flatnonzero((found < len(used)).any(axis=1))
                out[who[k + some], begin : begin + 64] = np.matmul(weight, dense[found[some]])
    return out


@dataclass
class ToxicityModel:
    table: np.ndarray | None
    bias: float
    slope: float
    base: float
    memory: dict[str, float] = field(default_factory=dict)

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word: the largest of its windows."""
        out = np.full(len(words), -np.inf)
        windows, of = _cut(words)
        lengths = np.array([len(w) for w in windows])
        for length in np.unique(lengths):
            for rows in np.array_split(found := np.flatnonzero(lengths == length), max(1, len(found) // 8_000)):
                total = np.zeros(len(rows), np.float32)
                for index, weight in _each(_codes([windows[i] for i in rows], int(length))):
                    total += np.float32(weight) * self.table[index]
                np.maximum.at(out, of[rows], total / _norm(int(length)) + self.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.base)
        own = [units(t) for t in texts]
        memory = self.memory
        new = [w for w in set().union(*own) if w not in memory]
        if len(memory) + len(new) > 250_000:  # words of this batch stay at hand, older ones are worked out again
            memory.clear()
            new = list(set().union(*own))
        if new:
            memory.update(zip(new, self.values(new).tolist(), strict=True))
        worst = _worst([np.fromiter(map(memory.__getitem__, o), float, len(o)) for o in own])
        return _any(worst, self.slope, self.base)


def _any(worst: np.ndarray, slope: float, base: float) -> np.ndarray:
    """The probability that any of a row's words is an insult."""
    return -np.expm1(-np.logaddexp(0, slope * worst + base).sum(axis=1))


def _worst(values: list[np.ndarray]) -> np.ndarray:
    """The largest values of each document, in falling order; LOW where there are fewer."""
    out = np.full((len(values), WORST), LOW)
    for row, v in zip(out, values, strict=True):
        top = np.sort(np.partition(v, len(v) - WORST)[-WORST:] if len(v) > WORST else v)[::-1]
        row[: len(top)] = np.clip(top, LOW, HIGH)
    return out


def _tail(hits: int, total: int, share: float) -> float:
    """Log of the chance of so many toxic documents among those with a word, if it told nothing."""
    logs = [math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(share) + (total - k) * math.log1p(-share) for k in range(hits, total + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def telling(hits: np.ndarray, all_: np.ndarray, share: float, tests: int) -> np.ndarray:
    """Places whose documents are toxic far more often than share explains, at one false find in all tests."""
    some = np.flatnonzero((hits >= 3) & (hits >= 0.8 * all_))
    known: dict[tuple[int, int], bool] = {}
    for n, m in {(int(hits[i]), int(all_[i])) for i in some}:
        known[n, m] = _tail(n, m, share) < -math.log(max(1, tests))
    return some[[known[int(hits[i]), int(all_[i])] for i in some]] if len(some) else some


def _alone(texts: list[str]) -> np.ndarray:
    """True for texts that share none of their smallest shingles with an earlier one: copies don't count as evidence."""
    seen: set[int] = set()
    out = np.zeros(len(texts), bool)
    for at in range(0, len(texts), 100):
        for i, s in enumerate(ngrams.shingle_sets(pa.array(texts[at : at + 100], pa.large_string())), at):
            first = s[:3].tolist()
            out[i] = not any(x in seen for x in first)
            seen.update(first)
    return out


def spelled(word: str, draw: np.random.Generator) -> str:
    """The word as one might hide it: one or two letters put in, one left out, replaced or said twice. The first and
    the last letter stay."""
    letter = lambda: _LETTERS[int(draw.integers(len(_LETTERS)))]
    k = int(draw.integers(1, len(word) - 1))
    kind = int(draw.integers(8))
    if kind < 3:
        return word[:k] + letter() + word[k:]
    if kind < 5:
        j = int(draw.integers(k, len(word)))
        return word[:k] + letter() + word[k:j] + letter() + word[j:]
    if kind < 7:
        return word[:k] + (letter() if kind == 6 else "") + word[k + 1 :]
    return word[: k + 1] + word[k:]


def _variants(words: list[str], each: int, draw: np.random.Generator) -> list[tuple[str, int]]:
    """Spellings of each word of LEAST_HIDDEN letters and more, and the word's place."""
    return [(spelled(w, draw), i) for i, w in enumerate(words) if len(w) >= LEAST_HIDDEN for _ in range(each)]


def _landmarks(words: list[str], gram: np.ndarray, count: int) -> np.ndarray:
    """Places of words by pivoted Cholesky: each next is the one least expressed by those before."""
    n = len(words)
    left, rows, picked = gram.diagonal().astype(float), np.zeros((0, n)), []
    for _ in range(min(count, n)):
        k = int(left.argmax())
        if left[k] < 1e-6:
            break
        row = (gram[k] - rows.T @ rows[:, k]) / math.sqrt(left[k])
        rows, left = np.vstack([rows, row]), np.maximum(left - row**2, 0)
        picked.append(k)
        left[k] = 0
    return np.array(picked, int)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(rounds):
        active = y * (a @ w) < 1
        c = cost * active
        new = np.linalg.solve(np.diag(ridge) + a.T @ (a * c[:, None]), a.T @ (c * y))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _calibrate(worst: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of the words' probabilities, of largest likelihood (with Platt's smoothed targets), by a grid
    that is refined around its best point."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 1.0, FALSE_ALARM)

    def loss(slope: float, base: float) -> float:
        p = np.clip(_any(worst, slope, base), 1e-9, 1 - 1e-9)
        return float(-(weight * (target * np.log(p) + (1 - target) * np.log1p(-p))).sum() + 1e-2 * slope**2)

    best, slopes, bases = (0.0, 1.0, 0.0), np.linspace(0.5, 12, 13), np.linspace(-9, 3, 13)
    for _ in range(4):
        best = min((loss(a, b), float(a), float(b)) for a in slopes if a > 0 for b in bases)
        slopes, bases = (np.linspace(c - (x[1] - x[0]), c + (x[1] - x[0]), 9) for c, x in ((best[1], slopes), (best[2], bases)))
    return best[1], best[2]


#: Beginnings of words are tested as classes, too: insults bear endings. Their lengths, and the classes of a hash.
BEGINNINGS, CLASSES = range(4, 9), 1 << 21


def positives(vocabulary: list[str], own: list[np.ndarray], toxic: np.ndarray) -> list[int]:
    """Words, or words that go on from a beginning, that tell toxic documents; own: each document's distinct words."""
    share = min(max(float(toxic.mean()), 1e-6), 1 - 1e-6)
    bad = [o for o, t in zip(own, toxic, strict=True) if t]
    count = lambda some, n: np.bincount(np.concatenate(some), minlength=n) if some else np.zeros(n, int)
    n = len(vocabulary)
    hits, all_ = count(bad, n), count(own, n)
    found = set(telling(hits, all_, share, n).tolist())
    random = _random_letters()
    lengths = np.array([len(w) for w in vocabulary])
    for length in BEGINNINGS:
        longer = np.flatnonzero(lengths > length)
        if not len(longer):
            continue
        codes = np.frombuffer("".join(vocabulary[i][:length] for i in longer).encode("utf-32-le"), np.uint32).reshape(-1, length)
        of = np.full(n, -1)
        of[longer] = (ngrams.mix((random[codes & np.uint32(4095)] * ngrams._PLACE[:length]).sum(axis=1)) % np.uint64(CLASSES)).astype(np.int64)
        classes = lambda some: [(u := np.unique(of[o]))[u >= 0] for o in some]
        telling_classes = telling(count(classes(bad), CLASSES), count(classes(own), CLASSES), share, n)
        found.update(np.flatnonzero(np.isin(of, telling_classes) & (hits == all_) & (hits >= 1)).tolist())
    return sorted(found, key=lambda i: (-hits[i], vocabulary[i]))


def _random_letters() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(3)).integers(0, 2**64, 4096, np.uint64) | np.uint64(1)


def fit(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS) -> ToxicityModel:
    """Learn from labelled texts (1: toxic)."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    none = ToxicityModel(None, 0.0, 0.0, share)
    if not 0 < share < 1:
        return none
    numbers: dict[str, int] = {}
    said = [np.array([numbers.setdefault(w, len(numbers)) for w in units(t)], np.int32) for t in texts]
    own = [np.unique(x) for x in said]
    vocabulary = list(numbers)
    alone = np.flatnonzero(_alone(texts))
    in_clean, in_toxic = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for o, t in zip(own, toxic, strict=True):
        (in_toxic if t else in_clean)[o] += 1
    insults = telling_words = positives(vocabulary, [own[i] for i in alone], toxic[alone])
    if not insults:
        return none
    del texts, own, alone
    draw = np.random.Generator(np.random.PCG64(6))
    clean = np.setdiff1d(np.flatnonzero(in_clean), telling_words)
    hard = draw.permutation(clean)[:HARD].tolist()
    n_first, recent = len(insults), hard
    for turn in range(TURNS):
        words = [vocabulary[i] for i in insults]
        hidden = [(w, i) for w, i in _variants(words[:n_first], max(2, SPELLINGS // n_first), draw) if w not in numbers]
        n = len(words) + len(hidden)
        seen = 10.0 * np.minimum(1 + in_toxic[insults], 60)
        times = np.bincount([i for _, i in hidden], minlength=len(words))
        cost = [*seen, *(HIDDEN_COST * seen[i] / times[i] for _, i in hidden)]
        words += [w for w, _ in hidden] + [vocabulary[i] for i in hard]
        some = draw.permutation(n)[: 2 * landmarks]
        half = [words[i] for i in some]
        near = [vocabulary[i] for i in recent[: 2 * landmarks]]
        base = [half[k] for k in _landmarks(half, kernel(half, half), landmarks // 2)]
        base += [near[k] for k in _landmarks(near, kernel(near, near), landmarks - len(base))]
        values, vectors = np.linalg.eigh(kernel(base, base))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])  # the Nyström map is k(x, landmarks) @ root
        y = np.where(np.arange(len(words)) < n, 1.0, -1.0)
        w = _svm(kernel(words, base) @ root, y, np.concatenate([cost, CLEAN_COST * np.minimum(1 + in_clean[hard], 30)]))
        weights = root @ w[:-1]
        table = np.zeros(1 << TABLE_BITS, np.float32)
        for who, index, weight in features(base):
            np.add.at(table, index, weights[who][:, None].astype(np.float32) * weight[None, :])
        model = ToxicityModel(table, float(w[-1]), 1.0, 0.0)
        found = model.values(vocabulary)
        if turn < TURNS - 1:
            # The clean words nearest to insults are learned from next, and words of toxic documents alone that
            # the machine takes for insults join them.
            fresh = np.setdiff1d(clean, hard)
            recent = fresh[np.argsort(-found[fresh], kind="stable")][:HARD].tolist()
            hard = hard + recent
            only = np.setdiff1d(np.flatnonzero((in_clean == 0) & (found > 0)), insults)
            insults = insults + only[np.argsort(-found[only], kind="stable")].tolist()
    # Words count as often as they stand in a document, as they do in scoring.
    worst, y = _worst([found[o] for o in said]), toxic.astype(float)
    # Clean documents with one insult set in count as toxic, too, as it is and in another spelling: few toxic documents
    # have no more than one.
    plain = worst[y == 0]
    often = in_toxic[insults[:n_first]] / in_toxic[insults[:n_first]].sum()
    picked = [vocabulary[insults[i]] for i in draw.choice(n_first, 2 * int(y.sum()), p=often)]
    set_in = [w if k % 2 or len(w) < LEAST_HIDDEN else spelled(w, draw) for k, w in enumerate(picked)]
    one = np.column_stack([plain[draw.integers(0, len(plain), len(set_in))], np.clip(model.values(set_in), LOW, HIGH)])
    slope, base = _calibrate(np.vstack([worst, -np.sort(-one, axis=1)[:, :WORST]]), np.concatenate([y, np.ones(len(one))]))
    return ToxicityModel(model.table, model.bias, slope, base)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> ToxicityModel:
    """Learn, in a task of its own, from at most so many toxic and clean documents; labels: doc_id and 0 or 1."""

    def of(sample: pd.DataFrame) -> ToxicityModel:
        sample = samples.one_each(sample)
        return fit(sample["text"].tolist(), sample["label_"].to_numpy(int))

    return samples.learned(samples.labelled_texts(docs, labels, label_col, {1: toxic, 0: clean}), of)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability of toxicity of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ToxicityModel(model.table, model.bias, model.slope, model.base))  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                yield pa.record_batch([part.column(0), pa.array(own.scores(part.column(1).to_pylist()).astype(float))], names=["doc_id", "score"])
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.7) -> DataFrame:
    """Documents that are not toxic; all columns are kept."""
    sent = docs.sparkSession.sparkContext.broadcast(ToxicityModel(model.table, model.bias, model.slope, model.base))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, place, 1 << 20):
                kept = own.scores([t or "" for t in part.column(place).to_pylist()]) < limit
                yield part.filter(pa.array(kept))
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
