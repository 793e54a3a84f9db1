"""Exact deduplication against an immutable snapshot.

A snapshot's distinct digests are dealt into shards by their leading bits; each shard has a static binary-fuse filter
of about 9 bits a key, built once, since a snapshot does not change. The digests of an incoming batch are grouped
among themselves, screened by the filters, and the positives join the snapshot's exact digests; their texts are then
compared byte by byte. Filters meet digests by shard: nothing that grows with the data is broadcast.

Defined cases: a null text counts as empty, so empty and null texts are copies of each other. Texts are equal when
identical after lower-casing A-Z. Each row is judged by its own text, also where rows share a doc_id. A null doc_id
ranks below all others. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import ascii_lower, attach, materialize, new_path, null_safe, partitions_for, semi_join, text_or_empty, without

#: Digests of a shard, and so the keys of one filter: about 70 KB.
SHARD_KEYS = 1 << 16
FILTERS = "shard long, seed long, segment long, span long, fingerprints binary"


class BinaryFuse8:
    """A static filter: no false negative, about one false positive in 256 others, 3 probes."""

    def __init__(self, seed: int, segment: int, span: int, fingerprints: np.ndarray):
        self.seed, self.segment, self.span, self.fingerprints = seed, segment, span, fingerprints

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        x = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    @staticmethod
    def _slots(h: np.ndarray, segment: int, span: int) -> np.ndarray:
        """Three slots in consecutive segments, one row each."""
        first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(37))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        """keys: distinct uint64. A seed that leaves a cycle is replaced by the next; the tries are bounded."""
        n = len(keys)
        segment = 4 if n < 4 else min(1 << int(np.log(n) / np.log(3.33) + 2.25), 1 << 18)
        wanted = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        span = max(1, -(-int(wanted) // segment) - 2) * segment
        for seed in range(1, 100):
            h = cls._mix(keys.astype(np.uint64), seed)
            slots = cls._slots(h, segment, span)
            rounds, alive = [], np.arange(n)
            while len(alive):
                at = slots[:, alive]
                degree = np.bincount(at.ravel(), minlength=span + 2 * segment)
                single = degree[at] == 1
                peeled = single.any(axis=0)
                if not peeled.any():
                    break
                rounds.append((alive[peeled], single[:, peeled].argmax(axis=0)))
                alive = alive[~peeled]
            if len(alive):
                continue
            out, prints = np.zeros(span + 2 * segment, np.uint8), cls._prints(h)
            for who, which in reversed(rounds):
                s = slots[:, who]
                own = s[which, np.arange(len(who))]
                out[own] = 0
                out[own] = prints[who] ^ out[s[0]] ^ out[s[1]] ^ out[s[2]]
            return cls(seed, segment, span, out)
        raise RuntimeError("no seed gave a filter: are the keys distinct?")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = self._mix(keys.astype(np.uint64), self.seed)
        s = self._slots(h, self.segment, self.span)
        return self._prints(h) == self.fingerprints[s[0]] ^ self.fingerprints[s[1]] ^ self.fingerprints[s[2]]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, SHA-256 and length in bytes of the text after lower-casing A-Z."""
    low = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(text_or_empty(text_col)).alias("low"))
    return low.select("doc_id", F.unhex(F.sha2("low", 256)).alias("digest"), F.octet_length("low").cast("long").alias("n_bytes"))


def _group(rows: DataFrame) -> DataFrame:
    """One row for each digest: rows are summed before they are shuffled, so a frequent text is no hot key."""
    return rows.groupBy("digest", "n_bytes").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))


def _shard(bits: int):
    return F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)


def _key(digest: pa.Array) -> np.ndarray:
    """Bytes 8 to 16 of each digest; its first four bytes choose the shard."""
    return np.frombuffer(b"".join(digest.to_pylist()), "<u8").reshape(-1, 4)[:, 1]


def build_filters(groups: DataFrame, bits: int) -> DataFrame:
    """A filter for each shard of a snapshot's distinct digests (its shard column has bits bits)."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        f = BinaryFuse8.build(np.unique(_key(table.column("digest").combine_chunks())))
        return pa.table({"shard": [key[0].as_py()], "seed": [f.seed], "segment": [f.segment], "span": [f.span], "fingerprints": [f.fingerprints.tobytes()]})

    return groups.select(_shard(bits).alias("shard"), "digest").groupBy("shard").applyInArrow(build, FILTERS)


def screen(groups: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """The groups whose digest may be in the snapshot."""
    names = groups.columns

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(names).slice(0, 0)
        r = right.to_pylist()[0]
        f = BinaryFuse8(r["seed"], r["segment"], r["span"], np.frombuffer(r["fingerprints"], np.uint8))
        return left.filter(pa.array(f.contains(_key(left.column("digest").combine_chunks())))).select(names)

    return groups.withColumn("shard", _shard(bits)).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(probe, groups.schema)


@dataclass
class Snapshot:
    """What is kept of an immutable snapshot: its digests, with the largest doc_id and the rows of each, and a filter for
    each shard of them. It is built once, and serves all deliveries that come later."""

    groups: DataFrame
    filters: DataFrame
    digests: int
    rows: int

    @property
    def bits(self) -> int:
        return max(0, (partitions_for(self.digests, SHARD_KEYS) - 1).bit_length())

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None) -> Snapshot:
        """Of rows as of digests(); written to path, or to the shared folder."""
        spark, path = rows.sparkSession, path or new_path(rows.sparkSession, "dedup-snapshot")
        _group(rows).write.parquet(f"{path}/groups")
        out = cls.load(spark, path, without_filters=True)
        build_filters(out.groups, out.bits).write.parquet(f"{path}/filters")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, without_filters: bool = False) -> Snapshot:
        groups = spark.read.parquet(f"{path}/groups")
        sizes = groups.agg(F.count(F.lit(1)).alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        return cls(groups, None if without_filters else spark.read.schema(FILTERS).parquet(f"{path}/filters"), sizes["digests"], sizes["rows"])


def match_batch(batch: DataFrame, snapshot: DataFrame, texts: DataFrame, stored: Snapshot | None = None) -> DataFrame:
    """Decide the rows of an immutable snapshot and of a new batch (both as of digests()) together.

    texts (doc_id, text) has the texts of both; stored: what was kept of the snapshot, else it is built. Returns doc_id,
    digest, keep_id (the largest doc_id of the equal texts) and group_size for every row of both.
    """
    stored = stored or Snapshot.build(snapshot)
    new, snap, filters, bits = _group(batch), stored.groups, stored.filters, stored.bits
    n_rows = stored.rows + batch.count()
    positives = screen(new, filters, bits).select("digest", "n_bytes", F.col("top").alias("new_id"), F.col("n").alias("new_n"))
    pairs = materialize(positives.join(snap.withColumnsRenamed({"top": "snap_id", "n": "snap_n"}), ["digest", "n_bytes"]), "dedup-positives")
    # A null doc_id is found as the least number.
    pairs = pairs.withColumns({"new_did": null_safe(F.col("new_id")), "snap_did": null_safe(F.col("snap_id"))})
    ids = pairs.select(F.explode(F.array("new_did", "snap_did")).alias("did")).distinct()
    own = texts.select(null_safe(F.col("doc_id")).alias("did"), "text")
    low = semi_join(own, ids, "did", 2 * pairs.count()).select("did", ascii_lower(text_or_empty("text")).alias("low"))
    # An id with several texts has several rows here: that with the digest of the pair counts.
    low = low.select("did", "low", F.unhex(F.sha2("low", 256)).alias("digest"))
    checked = pairs.join(low.select(F.col("did").alias("new_did"), "digest", F.col("low").alias("a")).dropDuplicates(["new_did", "digest"]), ["new_did", "digest"])
    checked = checked.join(low.select(F.col("did").alias("snap_did"), "digest", F.col("low").alias("b")).dropDuplicates(["snap_did", "digest"]), ["snap_did", "digest"])
    equal = materialize(checked.filter(F.col("a") == F.col("b")).select("digest", "n_bytes", F.greatest("new_id", "snap_id").alias("keep_id"), (F.col("new_n") + F.col("snap_n")).alias("group_size")), "dedup-equal")
    side = lambda rows, groups, name: attach(rows, groups.join(equal, ["digest", "n_bytes"], "left").select(
        "digest", "n_bytes", F.coalesce("keep_id", "top").alias("keep_id"), F.coalesce("group_size", "n").alias("group_size")
    ).filter("group_size > 1"), ["digest", "n_bytes"], "group_size", n_rows)
    both = side(snapshot, snap, "snapshot").unionByName(side(batch, new, "batch"))
    return both.select("doc_id", "digest", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    One half of the documents, by a hash of the id, is the snapshot, the other the incoming batch, so that one table
    goes the way that a corpus and its next delivery go.
    """
    rows = materialize(digests(docs, id_col, text_col), "dedup-digests")
    in_batch = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 1, F.lit(True))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = match_batch(rows.filter(in_batch), rows.filter(~in_batch), texts)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each text, that with the largest doc_id (null is the least); of rows that are the same in id and text
    one stays. All columns are kept."""
    found = materialize(exact_dedup(docs).select(null_safe(F.col("doc_id")).alias("_did"), "text_sha256", "group_size", "kept"), "dedup-decided")
    again = found.filter("kept and group_size > 1").groupBy("_did", "text_sha256").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    keys = {"_did": null_safe(F.col("doc_id")), "_digest": F.sha2(ascii_lower(text_or_empty("text")), 256)}
    name = lambda rows: rows.withColumnRenamed("text_sha256", "_digest")
    return without(docs, keys, name(found.filter("not kept")), name(again))
