"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, root being the smallest node reachable.

    Nodes without an edge to another node are not returned. Every round is a
    map-side combined minimum and an equi-join whose sides are plain scans, so
    a star centre with many leaves is split by adaptive execution.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        # Large star: a node hands the least of its neighbourhood to its larger neighbours.
        both = scratch.keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = scratch.keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: a node and its smaller neighbours hang on the least of them.
        least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.keep(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    scratch.drop("both", "least", "large")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
