"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node (aggregated before it is shuffled) joined back
to the edges, so that a node with very many edges is a skewed join, which
Spark splits, and never one group in one task. The minima are cut off from
their aggregation, since Spark splits only joins of two plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastline.llm.common import cut, cut_told


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node a to the smaller b."""
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"))
    joined = edges.join(least, F.col("a") == F.col("k"))
    return joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def _told(edges: DataFrame) -> tuple[DataFrame, dict]:
    # how many edges there are and a sum over their hashes tell whether a step changed anything
    return cut_told(edges, n=F.count(F.lit(1)), h=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for each node but the smallest itself."""
    edges, state = _told(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while state["n"]:
        before = state
        edges, state = _told(_small_star(_large_star(edges).distinct()).distinct())
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
