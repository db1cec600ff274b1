"""Connected components of an edge table by alternating large and small stars; every round is two joins, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import written


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(e: DataFrame) -> DataFrame:
    """Each larger neighbour is tied to the least node around."""
    near = _both(e)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component (the least node of its component) for every node of edges u, v (bigint). No edges, no rows. Loops and
    repeated edges don't matter. Each round is written to the shared folder; rounds are logarithmic in the longest path."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most):
        e = written(_small(_large(e)), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
