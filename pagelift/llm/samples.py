"""Bounded samples of labelled documents, and models that one task learns from them.

Defined cases: rows without id or label are not drawn; rows of one id have its largest label, and the first of its texts
is learned from; without any row a model is made of none. Documents above LONGEST bytes are not drawn.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import give_back

#: Bytes of the longest text that is learned from: it bounds a sample in bytes, as its caller does in rows.
LONGEST = 1 << 16


def first_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first rows by a hash of their key, at most so many. As they are counted before, hashes of which the first
    rows are almost surely all are filtered, and no task sorts or sends more than its share."""
    share = (1.2 * most + 100) / max(1, rows.count())
    if share < 0.9:
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64(key), 1) < int(2**63 * share))
    return rows.orderBy(F.xxhash64(key), *rows.columns).limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[object, int]) -> DataFrame:
    """doc_id, text and label_ of at most most[label] documents of each label, the first by a hash of the id.

    Only ids are ranked, so that no text but those of the sample is moved; the bound is the caller's parameter.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label_")).filter("doc_id is not null and label_ is not null")
    own = own.groupBy("doc_id").agg(F.max("label_").alias("label_"))
    picked = None
    for value, n in most.items():
        some = first_by_hash(own.filter(F.col("label_") == F.lit(value)), "doc_id", n)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.filter(F.octet_length("text") <= LONGEST).join(F.broadcast(picked), "doc_id")  # as many as most says


def one_each(sample: pd.DataFrame) -> pd.DataFrame:
    """A sample in an order of its own, with one text of each id."""
    return sample.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)


def learned(sample: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """What fit makes of a bounded sample, in one task, so that the driver holds no texts; the model is what it gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            sample = pa.Table.from_batches(found).to_pandas()
            del found
            model = pickle.dumps(fit(sample), protocol=5)
            del sample
            give_back()
            yield pa.record_batch([pa.array([model], pa.large_binary()).cast(pa.binary())], names=["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit(pd.DataFrame({f.name: [] for f in sample.schema}))  # noqa: S301  of our own task
