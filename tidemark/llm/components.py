"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import counted


def components(edges: DataFrame) -> DataFrame:
    """node and comp (its component's smallest node) of every node of ``edges`` (a, b: long, not null).

    Both steps group a node's neighbours only by their minimum, so a node with very
    many neighbours is a few partial rows; each round is checkpointed.
    """
    sums = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    held, before = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sums)
    while before[0]:
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        held, now = counted(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sums)
        if now == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(held.select(F.col("b"), F.col("b")).distinct())
        before = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("comp"))
