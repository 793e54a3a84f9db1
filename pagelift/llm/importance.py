"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Identical texts are collapsed by grouping whole texts, so each is counted and weighed once, times its copies. Features are
runs of words, hashed to buckets by crc32 of their bytes, over whole Arrow batches on bytes. The counts of both sides (one
number a bucket) give each bucket a gain; a text's weight is the sum of its gains, which is joined back to the documents by
the text's digest before each document's own noise is added. The highest scores are ranked by ranges.

Defined cases: null text is empty and has no features, weight 0. Rows of one id are scored each for itself, by the same
noise; without an id the noise is that of an empty one, and among equal scores such rows come last. With an empty table or
target all gains follow from the counts that there are. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import buffers
from .runtime import attach, materialize, running, slices, text_or_empty

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of words, after A-Z are lower-cased.
_INSIDE = np.array([48 <= b < 58 or 97 <= b < 123 or b > 127 for b in range(256)])
#: Features of more bytes are hashed one by one.
SHORT = 64
#: Bytes of a text that are looked at together.
WINDOW = 1 << 22


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32s(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, byte place after byte place for all runs that are long enough."""
    order = np.argsort(-np.minimum(lengths, SHORT + 1), kind="stable")
    at, sizes = starts[order], lengths[order]
    n_long = int((sizes > SHORT).sum())
    out = np.empty(len(starts), np.uint32)
    raw = memoryview(np.ascontiguousarray(body))
    for i in order[:n_long]:
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + lengths[i]])
    at, sizes = at[n_long:], sizes[n_long:]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    more = np.bincount(sizes, minlength=SHORT + 1)[::-1].cumsum()[::-1] if len(sizes) else np.zeros(SHORT + 1, int)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        k = int(more[j + 1])
        own = state[:k]
        state[:k] = _CRC[(own ^ body[at[:k] + j]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out[order[n_long:]] = ~state
    return out


def _features(body: np.ndarray, edges: np.ndarray, most: int, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 and text of each run of 1 to most words, and the place of each word; runs must end at or after fresh."""
    low = _FOLD[body]
    at = np.flatnonzero(_INSIDE[low])
    none = np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint32), none, none
    new = np.empty(len(at), bool)
    new[0], new[1:] = True, np.diff(at) > 1
    edge = np.zeros(len(body) + 1, bool)
    edge[edges] = True
    new |= edge[at]
    first = np.flatnonzero(new)
    n = len(first)
    lengths = np.diff(np.append(first, len(at)))
    # Words with one space after each: a run of words is a run of bytes.
    line = np.full(len(at) + n, 32, np.uint8)
    line[np.arange(len(at)) + np.repeat(np.arange(n), lengths)] = low[at]
    starts = first + np.arange(n)
    ends, places = starts + lengths, at[first]
    of = np.searchsorted(edges, places, "right") - 1
    crcs, texts = [], []
    for k in range(most):
        if n > k:
            ok = (of[: n - k] == of[k:]) & (places[k:] >= fresh)
            crcs.append(crc32s(line, starts[: n - k][ok], (ends[k:] - starts[: n - k])[ok]))
            texts.append(of[k:][ok])
    return np.concatenate(crcs), np.concatenate(texts), places


def features(texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """crc32 and text of each feature, and the text of each word, in blocks; a long text comes in windows that end between
    words, each with the last words of the one before."""
    body, edges = buffers(texts)
    if len(texts) > 1 or len(body) <= WINDOW:
        crcs, of, places = _features(body, edges, most, 0)
        yield crcs, of, np.searchsorted(edges, places, "right") - 1
        return
    begin = fresh = 0
    while fresh < len(body):
        end = min(len(body), fresh + WINDOW)
        while end < len(body) and _INSIDE[_FOLD[body[end - 1]]]:
            more = np.flatnonzero(~_INSIDE[_FOLD[body[end : end + WINDOW]]])
            end = end + int(more[0]) + 1 if len(more) else min(len(body), end + WINDOW)
        crcs, of, places = _features(body[begin:end], np.array([0, end - begin]), most, fresh - begin)
        yield crcs, of, np.zeros(int((places >= fresh - begin).sum()), np.int64)
        last = places[-(most - 1) :] if most > 1 else places[:0]
        begin, fresh = begin + int(last[0]) if len(last) else end, end


def bucket_counts(texts: DataFrame, buckets: int, most: int) -> np.ndarray:
    """How often the features of texts (text and n, its copies) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                copies = part.column(1).to_numpy()
                for crcs, of, _ in features(part.column(0), most):
                    own, times = (crcs % np.uint32(buckets)).astype(np.int64), copies[of]
                    sums += np.bincount(own[times == 1], minlength=buckets)
                    np.add.at(sums, own[times > 1], times[times > 1])
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    out = np.zeros(buckets, object)
    for r in texts.select("text", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many as buckets
        out[r["bucket"]] = r["n"]
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gain of each bucket from its counts in the documents (s) and in the target (t), in thousandths."""
    n, all_s, all_t = len(s), float(sum(s)), float(sum(t))
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (all_s + n) / ((float(a) + 1) * (all_t + n)))) for a, b in zip(s, t, strict=True)], np.int64)


def collapsed(docs: DataFrame) -> DataFrame:
    """text, n: the different texts and how many rows have each."""
    return docs.select(text_or_empty("text").alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def weights(texts: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """digest, copies, n_words, n_features and weight of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                n = part.num_rows
                words, found, sums = (np.zeros(n, np.int64) for _ in range(3))
                for crcs, of, word_of in features(part.column(0), most):
                    words += np.bincount(word_of, minlength=n)
                    found += np.bincount(of, minlength=n)
                    # Sums of whole numbers far below 2 ** 53 are exact.
                    sums += np.bincount(of, gain[crcs % np.uint32(len(gain))], n).astype(np.int64)
                yield pa.record_batch([part.column(2), part.column(1), *map(pa.array, (words, found, sums))], names=["digest", "copies", "n_words", "n_features", "weight"])

    return texts.select("text", "n", digest(F.col("text")).alias("digest")).mapInArrow(run, "digest binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel number of each id, in thousandths."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, most: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; rank is null for those that are not drawn.

    Drawn are percent of the documents with least_words words and more, by the highest scores, of equal ones the smaller
    ids. Features are runs of 1 to most words. A text with very many copies is joined by broadcast of its one row.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_or_empty("text")).alias("digest")), "importance-rows")
    texts = materialize(collapsed(docs), "importance-texts")
    gain = gains(bucket_counts(texts, buckets, most), bucket_counts(collapsed(target), buckets, most))
    weighed = materialize(weights(texts, gain, most), "importance-weights")
    joined = attach(rows, weighed, ["digest"], "copies", rows.count())
    scored = joined.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    # The last order among rows that are the same; written, so that it stays.
    scored = materialize(scored.withColumn("tie", F.monotonically_increasing_id()), "importance-scores")
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("tie")]
    ranked = running(fit, order, {"rank": F.lit(1).cast("long")}, "importance-ranks").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*names))
