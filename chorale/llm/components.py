"""Connected components of a graph that no machine holds: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the edges (a, b), the smallest node reachable.

    Each round hangs all neighbours of a node on its smallest one, first those above it, then those below;
    the rounds end when no edge changes, after about the logarithm of the longest path. Hubs don't matter to the
    minima, which are pre-aggregated; the joins are plain ones, whose large partitions Spark splits.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while (made := _mark(now)) != mark:
        mark = made
        now = stored(_small(_large(now)), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges have u above v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
