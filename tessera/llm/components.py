"""Connected components by alternating stars, distributed, with a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.sources.shared import release, steady


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of the edges (a, b); root is the smallest id reachable.

    Every round points each node at the smallest node it knows of: first its larger neighbours (large star),
    then itself and its smaller ones (small star). The rounds needed grow with the logarithm of the longest path.
    Minima are combined before the shuffle, and nodes with many neighbours meet only in joins, which adaptive
    execution splits. Self-links and repeated edges are allowed; without edges the result is empty.
    """
    steady(edges.sparkSession)
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while (now := _mark(edges)) != before:
        before, old = now, edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "edges")  # (larger, smaller)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        small = large.join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(small.unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        release(old, large)  # a round leaves one table
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
