"""Connected components by alternating stars, on tables that are written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node above has one node below, and none is both."""
    n = edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("u")).first()
    return n["n"] == n["u"] and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs); component is the smallest node that is reachable.

    Rounds of large-star and small-star; their number grows with the logarithm of the longest chain. Each round joins two
    written tables on the node, so Spark splits the partition of a hot centre. Loops count for nothing.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.table(e, "edges")
    while not _is_star_forest(e):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = scratch.table(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = scratch.table(both.join(least, "x").filter("y > x and m < y").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        small = scratch.table(joined.filter("u <> v").distinct(), "small")
        scratch.drop(e, least, large, least2)
        e = small
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
