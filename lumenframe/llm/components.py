"""Connected components of an edge table, by alternating large-star and small-star rounds. Nothing but a yes or no reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.frames import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these. Edges have a < b."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none: then each component is a star around its least node."""
    both = edges.select(F.col("b").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("a", F.lit(0), F.lit(1)))
    counted = both.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return counted.where("hangs > 1 OR hangs + holds > 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the least node reachable from it, for every node of an edge. Self-edges and repeats are harmless.

    Each round is written to the shared folder, so a lost executor costs a round's tasks, not the rounds before. The edges never
    grow beyond the input's; rounds grow with the logarithm of the longest chain, and end with stars. An empty table gives no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.save(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges", edges.count())
    while not _settled(now):
        after = scratch.save(_small_star(_large_star(now)), "round", now.count())
        scratch.drop(now)
        now = after
    ends = now.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return ends.union(now.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
