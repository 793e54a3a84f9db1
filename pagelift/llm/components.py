"""Connected components of a table of links, by alternating large and small stars.

Defined cases: links with a null, and of a node to itself, say nothing; repeated ones count once, in either direction. A
node without a link is not in the result; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import attach, materialize


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and root (the smallest id of its component) of every id that has a link to another; links: a and b.

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest chain. A node with very
    many links is joined by broadcast of its one row, so it is in no task alone.
    """
    edges = links.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "components")
    state = None
    for _ in range(most_rounds):
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _mins(both).select("a", "n", F.least("a", "least").alias("least"))
        # Large star: all larger neighbours go to the smallest.
        large = attach(both, least, ["a"], "n", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = materialize(large, "components")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        small = attach(large, _mins(large), ["a"], "n", n)
        small = small.select("a", F.col("least").alias("b")).unionByName(small.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        edges = materialize(small.distinct(), "components")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        state = new
    raise RuntimeError("the components did not settle")
