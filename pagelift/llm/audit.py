"""What each filter of a chain removes, in every order, by packed bitmaps.

Texts are read once, into a narrow table of failures, part and digest; equal texts and labels are joined to it by digest
and id. Each task then packs its rows into bitsets for filters, labels and parts, and counts, for every set of filters
that may have gone before, what is left and what each other filter removes of it: AND-NOT and a population count. Only
these counts are summed up; the orders are read off them.

Defined cases: null text is empty, a null part is the empty string. A row without an id fails nothing by its copies and
has no label; rows of one id are not copies of each other, but of a smaller one's text. Of several labels of an id any 1
counts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import UPPER, attach, materialize, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = "part string, mask int, filter int, before long, removed long, good long, toxic long"
#: Parts whose counts a task holds before it sends them on.
HELD_PARTS = 10_000
#: So many values of a salt spread the rows without an id.
SALTS = 1000


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, the failures of the filters A to E as the bits of fails, good and toxic, for each row of docs.

    A: under 200 words; B: less than half of them distinct; C: over 3 % capitals; D: one of the signs #$%&*|; E: the text
    of a smaller id. Copies of one text meet by broadcast if they are many (attach), ids in a join that Spark may split.
    """
    text, words = text_or_empty("text"), F.regexp_extract_all(text_or_empty("text"), F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialize(rows, "audit-rows")
    same = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = attach(rows, materialize(same, "audit-copies"), ["digest"], "n", rows.count())
    own = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = own.filter("doc_id is not null").withColumn("salt", F.lit(0).cast("long"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0).cast("long"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    out = rows.join(own, ["doc_id", "salt"], "left")
    return out.select("part", (F.col("bits") + copy).alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _packed(flags: np.ndarray) -> np.ndarray:
    """Flags (in the last axis) as words of 64 bits."""
    bits = np.packbits(flags, axis=-1)
    pad = -bits.shape[-1] % 8
    return np.ascontiguousarray(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])).view(np.uint64)


def _ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def bitmap_counts(own: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """before, removed, good and toxic by set of filters (bits of the first axis) and filter; own and fails are bitsets."""
    n = len(fails)
    out = np.zeros((1 << n, n, 4), np.int64)
    left: list[np.ndarray] = [own]
    for mask in range(1 << n):
        if mask:
            last = mask.bit_length() - 1
            left.append(left[mask ^ 1 << last] & ~fails[last])
        before = _ones(left[mask])
        for f in range(n):
            if not mask >> f & 1:
                hit = left[mask] & fails[f]
                out[mask, f] = before, _ones(hit), _ones(hit & good), _ones(hit & toxic)
    return out


def _count(n: int):
    """Counts of a task's rows by part, set of filters and filter."""

    def rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        found = [(part, mask, f, *map(int, own[mask, f])) for part, own in sums.items() for mask in range(1 << n) for f in range(n) if not mask >> f & 1]
        kinds = [pa.string(), pa.int32(), pa.int32()] + [pa.int64()] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[c.split()[0] for c in COUNTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            fails, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            failing = _packed((fails[None, :] >> np.arange(n)[:, None] & 1).astype(bool))
            labels = _packed(good == 1), _packed(toxic == 1)
            parts = batch.column(0).dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False)
            for code, part in enumerate(parts.dictionary.to_pylist()):
                found = bitmap_counts(_packed(codes == code), failing, *labels)
                sums[part] = sums[part] + found if part in sums else found
            if len(sums) > HELD_PARTS:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    return run


def audit(failing: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. failing: part, fails (bits in the order of filters), good and toxic (1 if so).

    The table of orders (600 rows for five filters) is broadcast; everything else grows with parts only.
    """
    n, spark = len(filters), failing.sparkSession
    counts = failing.select("part", "fails", "good", "toxic").mapInArrow(_count(n), COUNTS).groupBy("part", "mask", "filter")
    counts = materialize(counts.agg(*(F.sum(c).alias(c) for c in ("before", "removed", "good", "toxic"))), "audit-counts")
    gone = F.bit_count("mask")
    weight = F.get(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), gone)
    whole = counts.groupBy("part", "filter").agg(F.max(F.when(gone == 0, F.col("removed"))).alias("fails"), F.max(F.when(gone == n - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    orders = [("".join(filters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), f) for order in permutations(range(n)) for k, f in enumerate(order)]
    orders = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, mask int, filter int"))
    rows = counts.join(orders, ["mask", "filter"]).join(whole, ["part", "filter"])
    return rows.select("part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
