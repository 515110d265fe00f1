"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, store


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours, from rows (u, v)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))


def _linked(stars: DataFrame) -> DataFrame:
    return stars.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (a, b) of one type, in any direction, repeated or not. Returns stored (node, root) for each node that has a smaller node in its component.

    Each round hangs all larger neighbours of a node, then all smaller ones, on the smallest; rounds
    follow each other until the edges stay as they are, about the logarithm of the longest path. A
    smallest neighbour is an aggregate that is written before it meets the edges, so a node with very
    many edges is a skewed join that Spark splits, never a group in one task. Null ends are left out.
    """
    now = store(_linked(edges.where("a is not null and b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))))
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = store(_least(both))
        large = store(_linked(both.join(mins, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        drop(mins), drop(now)
        mins = store(_least(large))
        met = large.join(mins, F.col("u") == F.col("c"))
        now = store(_linked(met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select(F.col("c").alias("u"), F.col("m").alias("v")))))
        drop(mins), drop(large)
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
