"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps are a grouped minimum (combined before the shuffle) and an equi-join that
adaptive execution may split, so a node with very many neighbours is no single task's
work. Each round is written to shared storage; the number of rounds grows with the
logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return linked.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b longs) -> (node, component): each node with an edge, and the smallest node it reaches.

    Self-edges and repeated edges are harmless; nulls are ignored; no edges give no rows.
    """
    edges = saved(edges.toDF("a", "b").where("a <> b").distinct(), "edges")
    while True:
        edges = saved(_small_star(_large_star(edges)), "edges")
        # Done when all that is left are stars: each child has one parent, which is no child.
        child, parent = edges.select("b").withColumn("child", F.lit(1)), edges.select("a").distinct().withColumn("child", F.lit(1))
        if child.union(parent).groupBy("b").agg(F.sum("child").alias("n")).where("n > 1").isEmpty():
            break
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
