"""Mixing of sources to target weights by hash thresholds: built-in functions only, and no sort of documents.

Each document has a place, a hash of its id and text. A source's target is met by taking all its documents as many whole
times as fit, and once more those whose place is below a threshold. The threshold is found from a histogram of tokens by
source and bucket of the place: the bucket in which the target is reached is the only one that is counted again, in finer
buckets, until a single place is left. Thresholds grow with the target, so the mix of a smaller budget lies within that
of a larger one. What grows with the documents is one narrow table of sizes and places; documents themselves are only
filtered. Sources are ordered, and their targets levelled, by running sums over ranges, so they may be many.

Defined cases: null text has no words. A null source is a source of its own, the last one. A source without words has the
target 0. Rows that are the same in id and text have one place, so they are taken alike; a missing id counts as empty.
The document at the threshold is taken if that brings its source nearer to the target. An empty table gives no rows.
Columns of the documents with the names of the result's give way to these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, attach_sized, materialize, running, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a bucket, and levels of buckets: a place has BITS * LEVELS bits.
BITS, LEVELS = 10, 6
#: A threshold above every place.
ALL = 1 << (BITS * LEVELS)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def place(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of a digest of id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _measured(docs: DataFrame, seed: int) -> dict[str, Column]:
    """key_ tells sources apart and is never null."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return {"key_": key, "size_": words(text_or_empty("text")), "place_": place(F.col("doc_id"), text_or_empty("text"), seed)}


def targets(sizes: DataFrame, weights: tuple[int, ...], shares: tuple[float, ...], most: int) -> DataFrame:
    """key_, source_size, rows_, and for each share its number mix_ and the source's target.

    sizes: key_ and size_. Weights go round over the sources in code point order, null last. A share of all words is dealt
    by weight; no target is above most times its source, and what is above goes to the others by weight. That is the level
    of water poured over all: a source is full if the water that fills it does not need more than there is.
    """
    sources = sizes.groupBy("key_").agg(F.sum("size_").alias("source_size"), F.count(F.lit(1)).alias("rows_"))
    ordered = running(sources, [F.col("key_") == "", F.col("key_")], {"rank_": F.lit(1)}, "mixing-sources")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("rank_") - 1, F.lit(len(weights))).cast("int"))
    weighed = ordered.withColumns({"weight_": weight.cast("long"), "full_": F.col("source_size") * most})
    levels = running(weighed, [F.col("full_") / F.col("weight_"), F.col("key_")], {"fulls_": F.col("full_"), "weights_": F.col("weight_")}, "mixing-levels")
    levels = materialize(levels, "mixing-levels")
    all_words, all_weights = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight_"), F.lit(0))).first()
    out = None
    for k, share in enumerate(shares):
        budget = int(all_words * share)
        poured = F.col("fulls_").cast("decimal(38,0)") * F.col("weight_") + F.col("full_").cast("decimal(38,0)") * (F.lit(all_weights) - F.col("weights_"))
        is_full = poured <= F.lit(budget).cast("decimal(38,0)") * F.col("weight_")
        held, open_weights = levels.agg(F.coalesce(F.sum(F.when(is_full, F.col("full_"))), F.lit(0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight_"))), F.lit(0))).first()
        level = (F.col("weight_") * F.lit(budget - held)).cast("double") / F.lit(float(max(1, open_weights)))
        one = levels.select("key_", "source_size", "rows_", F.lit(k).alias("mix_"), F.when(is_full, F.col("full_").cast("double")).otherwise(level).alias("target"))
        out = one if out is None else out.unionByName(one)
    return out


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with whole_ and threshold_: a document is taken whole_ times, and once more if its place is below threshold_.

    sizes: key_, size_ and place_. Rows are joined by source and bucket, so a frequent source is dealt over its buckets.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = wanted.withColumn("whole_", whole.cast("long"))
    state = state.withColumns({"left_": F.col("target") - F.col("whole_") * F.col("source_size"), "bucket_": F.lit(0).cast("long"), "threshold_": F.lit(None).cast("long")})
    state = materialize(state.withColumn("threshold_", F.when(F.col("left_") <= 0, F.lit(0).cast("long"))), "mixing-state")
    for level in range(1, LEVELS + 1):
        going = state.filter("threshold_ is null")
        n_going = going.count()
        if not n_going:
            break
        outer, inner = F.shiftright("place_", BITS * (LEVELS - level + 1)), F.shiftright("place_", BITS * (LEVELS - level))
        rows = sizes.withColumns({"bucket_": outer, "inner_": inner})
        if level > 1:  # at first all buckets are one
            only = going.select("key_", "bucket_").distinct()
            rows = rows.join(F.broadcast(only) if n_going <= BROADCAST_ROWS else only, ["key_", "bucket_"], "left_semi")
        histogram = rows.groupBy("key_", "bucket_", "inner_").agg(F.sum("size_").alias("unit_"), F.min("place_").alias("low_"), F.max("place_").alias("high_"))
        upto = Window.partitionBy("mix_", "key_").orderBy("inner_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = going.join(histogram, ["key_", "bucket_"]).withColumn("sum_", F.sum("unit_").over(upto))
        hit = found.filter((F.col("sum_") >= F.col("left_")) & (F.col("sum_") - F.col("unit_") < F.col("left_")))
        rest = F.col("left_") - (F.col("sum_") - F.col("unit_"))
        at_end = F.when(F.col("unit_") - rest < rest, F.col("low_") + 1).otherwise(F.col("low_"))
        hit = hit.select("mix_", "key_", rest.alias("rest_"), "inner_", F.when(F.col("low_") == F.col("high_"), at_end).alias("end_"))
        # Rounding may leave a target a hair above all its words: then all are taken.
        new = going.join(hit, ["mix_", "key_"], "left").withColumns({"threshold_": F.when(F.col("inner_").isNull(), F.lit(ALL)).otherwise(F.col("end_")), "left_": F.coalesce("rest_", "left_"), "bucket_": F.coalesce("inner_", "bucket_")})
        state = materialize(state.filter("threshold_ is not null").unionByName(new.select(*state.columns)), "mixing-state")
    return state.drop("left_", "bucket_")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), shares: tuple[float, ...] = (1.0,), most: int = 3, seed: int = 2024) -> DataFrame:
    """docs with size, source_size, target and taken: the words of a row, of its source, the source's target, and how many
    the mix takes (size times repeats). For several shares of all words: target_0, taken_0, target_1 and so on."""
    sizes = materialize(docs.select(*(c.alias(k) for k, c in _measured(docs, seed).items())), "mixing-sizes")
    wanted = thresholds(sizes, targets(sizes, weights, shares, most))
    names = [""] if len(shares) == 1 else [f"_{k}" for k in range(len(shares))]
    cut = F.struct("mix_", "target", "whole_", "threshold_")
    cuts = materialize(wanted.groupBy("key_").agg(F.first("source_size").alias("source_size"), F.first("rows_").alias("rows_"), F.array_sort(F.collect_list(cut)).alias("cuts_")), "mixing-cuts")
    n_sources, n_rows = cuts.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows_"), F.lit(0))).first()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), *(c.alias(k) for k, c in _measured(docs, seed).items()))
    rows = attach_sized(rows, cuts, ["key_"], "rows_", n_rows, n_sources)
    out = {"size": F.col("size_"), "source_size": F.col("source_size")}
    for k, name in enumerate(names):
        own = F.get("cuts_", F.lit(k))
        out |= {f"target{name}": own["target"], f"taken{name}": F.col("size_") * (own["whole_"] + (F.col("place_") < own["threshold_"]).cast("long"))}
    kept = [F.col("row_").getField(c).alias(c) for c in docs.columns if c not in out]
    return rows.select(*kept, *(c.alias(k) for k, c in out.items()))
