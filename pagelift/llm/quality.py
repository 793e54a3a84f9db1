"""Quality by a sparse rule ensemble.

Each text gives some twenty statistics. Small boosted trees are fitted on a bounded sample of labelled rows, every path
from a root to a node is a conjunctive rule, lasso logistic regression keeps few rules with weights, and the rules are
compiled to Spark column expressions over the statistics, in which all rows are scored.

Defined cases: null text is empty; its statistics are 0 and it has a score like any other. Without labelled rows of
both kinds every score is (n1 + 1) / (n + 2), of n rows with n1 of label 1, or 0.5. Repeated rows have a row each, an empty table none. A doc_id
that occurs in several rows is learned from by each. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams, samples
from .runtime import arrow_map, materialize, small_batches, text_or_empty

#: Most labelled rows that the model is fitted on, by the order of a hash of the id.
SAMPLE_ROWS = 20_000

_bytes = np.arange(256)
_KINDS = {
    "upper": (_bytes >= 65) & (_bytes < 91),
    "lower": (_bytes >= 97) & (_bytes < 123),
    "digit": (_bytes >= 48) & (_bytes < 58),
    "not_ascii": _bytes >= 128,
    "stop": np.isin(_bytes, list(b".,;:?")),
    "exclaim": _bytes == ord("!"),
    "bar": np.isin(_bytes, list(b"|/\\")),
    "symbol": np.isin(_bytes, list(b"#$%&*+<=>@^_~`{}[]")),
    "line": _bytes == 10,
    "space": ngrams.SPACE,
}
FEATURES = ["log_bytes", "log_words", *_KINDS, "word_bytes", "long_words", "distinct_words", "repeats", "top_word", "distinct_lines", "line_words"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    body, offsets = ngrams.buffers(texts)
    n, size = len(offsets) - 1, np.diff(offsets)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    out: dict[str, np.ndarray] = {"log_bytes": np.log1p(size)}
    for kind, which in _KINDS.items():
        ends = np.concatenate([[0], np.cumsum(which[body], dtype=np.int64)])
        out[kind] = share(ends[offsets[1:]] - ends[offsets[:-1]], size)

    def counted(separators: np.ndarray, fold: bool) -> tuple[np.ndarray, ...]:
        hashes, starts, of = ngrams.words(body, offsets, separators, fold)
        total = np.bincount(of, minlength=n).astype(float)
        own = hashes ^ ngrams.mix(of.astype(np.uint64))  # a text's words differ from others'
        order = np.sort(own)
        first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, int)
        times = np.diff(np.append(first, len(order)))
        rank = np.argsort(own, kind="stable")
        text = of[rank[first]] if len(first) else np.zeros(0, int)
        top = np.zeros(n)
        np.maximum.at(top, text, times)
        return hashes, starts, of, total, np.bincount(text, minlength=n).astype(float), top

    hashes, starts, of, total, distinct, top = counted(ngrams.SPACE, True)
    out["log_words"] = np.log1p(total)
    spaces = np.concatenate([[0], np.cumsum(ngrams.SPACE[body], dtype=np.int64)])
    out["word_bytes"] = share(size - (spaces[offsets[1:]] - spaces[offsets[:-1]]), total)
    gap = np.diff(np.append(starts, len(body))) if len(starts) else np.zeros(0)
    out["long_words"] = share(np.bincount(of[gap > 20], minlength=n), total)
    out["distinct_words"], out["top_word"] = share(distinct, total), share(top, total)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) if len(hashes) else np.zeros(0, int)
    out["repeats"] = share(np.bincount(of[same], minlength=n), total)
    _, _, _, lines, other, _ = counted(_bytes == 10, False)
    out["distinct_lines"], out["line_words"] = share(other, lines), share(total, lines)
    return np.nan_to_num(np.stack([out[f] for f in FEATURES], axis=1))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = statistics(batch.column(1))
        return pa.record_batch([batch.column(0), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES), one, text=1)


#: A rule is a conjunction of (feature, is_over, limit).
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    base: float

    def column(self) -> Column:
        """The probability of label 1 as an expression over FEATURES."""
        total = F.lit(float(self.base))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for feature, over, limit in rule:
                c = F.col(FEATURES[feature])
                test = c > F.lit(float(limit)) if over else c <= F.lit(float(limit))
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + _matrix(self.rules, x) @ np.array(self.weights, float)))) if self.rules else np.full(len(x), 1 / (1 + np.exp(-self.base)))


def _matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for feature, over, limit in rule:
            out[:, k] *= x[:, feature] > limit if over else x[:, feature] <= limit
    return out


def tree_rules(x: np.ndarray, gradient: np.ndarray, depth: int, least: int, cuts: list[np.ndarray]) -> tuple[list[Rule], np.ndarray]:
    """Paths to all nodes of a least-squares tree on the gradient, and the tree's fit."""
    rules, fit = [], np.zeros(len(x))
    todo: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        own, best = gradient[rows], None
        fit[rows] = own.mean()
        if path:
            rules.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            continue
        total, n = own.sum(), len(rows)
        for feature, limits in enumerate(cuts):
            if not len(limits):
                continue
            place = np.searchsorted(limits, x[rows, feature], "left")  # <= limits[k] has place <= k
            count = np.cumsum(np.bincount(place, minlength=len(limits) + 1))[:-1]
            below = np.cumsum(np.bincount(place, own, minlength=len(limits) + 1))[:-1]
            ok = (count >= least) & (n - count >= least)
            if ok.any():
                gain = np.where(ok, below**2 / np.maximum(count, 1) + (total - below) ** 2 / np.maximum(n - count, 1), -np.inf)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0]:
                    best = (gain[k], feature, limits[k])
        if best is not None and best[0] > total**2 / n + 1e-9:
            _, feature, limit = best
            low = x[rows, feature] <= limit
            todo += [((*path, (feature, False, float(limit))), rows[low]), ((*path, (feature, True, float(limit))), rows[~low])]
    return rules, fit


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and base of logistic regression with an L1 penalty on the weights (accelerated proximal gradient)."""
    n, k = a.shape
    w, base = np.zeros(k), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    v, vb, momentum = w.copy(), base, 1.0
    probe = np.random.Generator(np.random.PCG64(0)).normal(size=k + 1)
    for _ in range(20):  # the largest eigenvalue gives the step
        probe /= np.linalg.norm(probe)
        z = a @ probe[:k] + probe[k]
        probe = np.append(a.T @ z, z.sum()) / n
    step = 4 / max(np.linalg.norm(probe) * 1.05, 1e-9)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(a @ v + vb))) - y
        new = v - step * (a.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_base = vb - step * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = new + (momentum - 1) / following * (new - w), new_base + (momentum - 1) / following * (new_base - base)
        w, base, momentum = new, new_base, following
    return w, float(base)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        mean = 0.5 if len(y) == 0 else (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], [], float(np.log(mean / (1 - mean))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50))) for f in range(x.shape[1])]
    least, margin = max(5, len(y) // 500), np.zeros(len(y))
    rules: dict[Rule, None] = {}
    draw = np.random.Generator(np.random.PCG64(4))
    for _ in range(trees):
        some = [c if draw.random() < 0.6 else c[:0] for c in cuts]
        found, step = tree_rules(x, y - 1 / (1 + np.exp(-margin)), depth, least, some)
        rules |= dict.fromkeys(tuple(sorted(r)) for r in found)
        margin = margin + 2 * step
    kept, seen = [], set()
    for rule, column in zip(rules, _matrix(list(rules), x).T, strict=True):
        if (key := column.tobytes()) not in seen:  # rules that hold for the same rows count once
            seen.add(key)
            kept.append(rule)
    a = _matrix(kept, x)
    w, base = lasso_logistic(a, y, penalty)
    use = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([kept[i] for i in use], [float(w[i]) for i in use], base)


def train(stats: DataFrame, labels: DataFrame, label_col: str, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most sample_rows labelled rows; labels: doc_id and a label of 0 or 1."""
    own = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("int").alias("y_")).filter("y_ in (0, 1)")
    rows = samples.first_by_hash(stats.join(own, "doc_id"), "doc_id", sample_rows).select(*FEATURES, "y_")
    return samples.learned(rows, lambda found: fit(found[FEATURES].to_numpy(float), found["y_"].to_numpy(float)))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and the probability of label 1 for every row, learned from labels."""
    stats = materialize(with_statistics(docs), "quality-statistics")
    return stats.select("doc_id", train(stats, labels, label_col, sample_rows).column().alias("score"))
