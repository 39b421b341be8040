"""PageRank, global or personalised by seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.staging import discard, numbered, staged

DAMPING, ITERATIONS, TOLERANCE, LIMIT = 0.85, 50, 1e-6, 20
#: Links and nodes up to which the ranks are computed in one numpy kernel on the driver: 8 bytes a link as they come,
#: some 40 at work, and 40 a node, together 320 MB at most.
KERNEL_LINKS = 4_000_000


def resolve_seeds(graph, seeds: list[str] | DataFrame) -> DataFrame:
    """Column id: for each seed (texts, or a table with a column seed) the node of that id, else symbols of that name and
    files of that path."""
    wanted = seeds.select("seed").distinct() if isinstance(seeds, DataFrame) else graph.spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed string")
    nodes = graph.raw_nodes.select("id", "kind", "name", "path")
    exact = wanted.join(nodes, wanted.seed == nodes.id).select("seed", "id")
    rest = wanted.join(exact.select("seed"), "seed", "left_anti")
    named = rest.join(nodes.where("kind = 'symbol'"), F.col("seed") == F.col("name")).select("id")
    files = rest.join(nodes.where("kind = 'file'"), F.col("seed") == F.col("path")).select("id")
    return exact.select("id").unionByName(named).unionByName(files).distinct()


def _kernel(n: int, src: np.ndarray, dst: np.ndarray, teleport: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    degree = np.bincount(src, minlength=n)
    rank, share = np.full(n, 1 / n), np.divide(1.0, degree, where=degree > 0, out=np.zeros(n))
    for _ in range(iterations):
        flow = np.bincount(dst, weights=(rank * share)[src], minlength=n)
        new = (1 - DAMPING) * teleport + DAMPING * (flow + rank[degree == 0].sum() * teleport)
        delta, rank = np.abs(new - rank).sum(), new
        if delta < tolerance:
            break
    return rank


def _small(links: DataFrame, seeds: DataFrame, n: int, iterations: int, tolerance: float) -> DataFrame:
    """All rounds in one kernel on the driver. Only numbers reach it, 8 bytes a link."""
    table = links.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).toArrow()
    src, dst = (table[c].to_numpy() for c in ("src", "dst"))
    chosen = seeds.toArrow()["id"].to_numpy()
    teleport = np.zeros(n)
    teleport[chosen] = 1
    teleport = teleport / teleport.sum() if len(chosen) else np.full(n, 1 / n)
    rank = _kernel(n, src, dst, teleport, iterations, tolerance)
    return links.sparkSession.createDataFrame(pa.table({"id": np.arange(n), "score": rank}), "id long, score double")


def _large(nodes: DataFrame, links: DataFrame, seeds: DataFrame, n: int, iterations: int, tolerance: float) -> DataFrame:
    """One join and one aggregation a round over links dealt by source once; ranks are written each round."""
    out = staged(links.groupBy("src", "dst").agg(F.count("*").alias("times")), "links")
    degree = out.groupBy("src").agg(F.sum("times").alias("degree"))
    k = seeds.join(nodes, "id", "left_semi").count()
    own = F.when(F.col("seeded"), F.lit(1 / max(k, 1))).otherwise(F.lit(0.0)) if k else F.lit(1 / n)
    base = nodes.join(seeds.withColumn("seeded", F.lit(True)), "id", "left").select("id", F.coalesce("seeded", F.lit(False)).alias("seeded"))
    base = staged(base.withColumn("teleport", own).join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", "teleport", "degree"), "base")
    rank = old = staged(base.withColumn("score", F.lit(1 / n)), "rank")
    for _ in range(iterations):
        idle = rank.where("degree is null").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        share = rank.where("degree is not null").select(F.col("id").alias("src"), (F.col("score") / F.col("degree")).alias("share"))
        flow = out.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("times")).alias("flow"))
        score = (1 - DAMPING) * F.col("teleport") + DAMPING * (F.coalesce("flow", F.lit(0.0)) + F.lit(idle) * F.col("teleport"))
        new = staged(rank.join(flow, "id", "left").select("id", "teleport", "degree", score.alias("score"), F.col("score").alias("before")), "rank")
        delta = new.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0]
        discard(old)
        old, rank = new, new.drop("before")
        if delta < tolerance:
            break
    return rank.select("id", "score")


def pagerank(graph, seeds: list[str] | DataFrame | None = None, limit: int | None = LIMIT, kind: str | None = None, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """Node columns and score, the ``limit`` best by score, then id; of one node kind if ``kind`` is given.

    All edge kinds count and parallel edges count again; edges with an end that is no node do not. Idle nodes give
    their rank by the teleport vector: the seeds that resolve, or all nodes. Ranks stop after ``iterations`` rounds or
    once a round moves less than ``tolerance``. Up to ``kernel_links`` links (a counted size) one numpy kernel does all
    rounds; beyond it each round is a join and an aggregation.
    """
    known = numbered(graph.nodes().select("id"), "n")
    ends = [known.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n")) for c in ("src", "dst")]
    # the joins that number the ends also drop links without a node; all rounds are over numbers
    links = graph.edges().select("src", "dst").join(ends[0], "src").join(ends[1], "dst")
    links = staged(links.select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")), "links")
    found = known.join(resolve_seeds(graph, [] if seeds is None else seeds), "id", "left_semi").select(F.col("n").alias("id"))
    n, many = known.count(), links.count()
    if n == 0:
        return graph.nodes().withColumn("score", F.lit(0.0))
    small = many <= kernel_links and n <= kernel_links
    scores = _small(links, found, n, iterations, tolerance) if small else _large(known.select(F.col("n").alias("id")), links, found, n, iterations, tolerance)
    scores = known.join(scores.withColumnRenamed("id", "n"), "n").select("id", "score")
    ranked = graph.nodes().join(scores, "id")
    if kind:
        ranked = ranked.where(F.col("kind") == kind)
    return ranked if limit is None else ranked.orderBy(F.desc("score"), "id").limit(max(0, limit))
