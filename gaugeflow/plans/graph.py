"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for an edge list ``(a, b)``; a component is its least node.

    Every step joins the edges with one minimum per node, so no neighbour list is ever
    collected; edges are written out after each round, until a round changes nothing.
    """
    both = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = cut_lineage(both.distinct())
    seen = None
    while True:
        current = cut_lineage(_small_star(_large_star(current)))
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select("b", "b").distinct()
            )
        seen = mark


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    way = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = way.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = way.join(least, "a").filter(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).filter("a <> b").distinct()
