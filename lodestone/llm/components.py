"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.staging import discard, staged

MAX_ROUNDS = 60


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    joined = both.join(_min_neighbour(both), "u").where("v > u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    joined = down.join(_min_neighbour(down), "u")
    moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Each round is two aggregations with map-side combining and two joins that AQE can split, and is written to the
    shared folder. The number of rounds grows with the logarithm of the longest chain. No part of the graph reaches
    the driver; only a count and a checksum of the links do. An empty table gives an empty result.
    """
    mark, now = None, staged(edges.select("a", "b").where("a <> b").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        before, now = now, staged(_small_star(_large_star(now)), "links")
        discard(before)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if seen == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        mark = seen
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
