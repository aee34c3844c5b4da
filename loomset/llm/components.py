"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import discard, keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component's name is its least node.

    Every step keeps one row for each edge at most and needs a minimum for each node, which partial
    aggregates give, so a node with very many neighbours is no task of its own. Steps are cut by tables
    in the shared folder. An edge from a node to itself makes a component of one.
    """
    alone = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = keep(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        after = keep(_small_star(_large_star(now)).distinct(), "edges")
        discard(now)
        now = after
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.union(centres).union(alone).groupBy("node").agg(F.min("component").alias("component"))
