"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksift.session import cut, drop_paths


def nearer(edges: DataFrame) -> DataFrame:
    """One round, a large-star and a small-star: edges (a, b) with a < b that connect the same nodes, each nearer to its least one."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # an edge comes from its lesser end alone, so there are never more than before; repeated ones go at the end of the round
    large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    least = large.groupBy("b").agg(F.min("a").alias("m"))
    ends = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b"))
    return cut(ends.where("b <> m").select(F.col("m").alias("a"), "b").distinct(), "cc")


def _done(edges: DataFrame) -> bool:
    """Whether every node is b of one edge and a of none, or the other way round."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("b")), F.struct(F.col("b").alias("node"), F.lit(1).alias("b")))).alias("end"))
    ends = ends.groupBy("end.node").agg(F.sum("end.b").alias("n"), F.min("end.b").alias("least"))
    return ends.agg(F.count(F.when((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("least") == 0)), 1))).first()[0] == 0


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): the least node of its component, for every other node of an edge (a, b) between longs.

    Each round halves distances at least, so rounds grow with the logarithm of the longest path. Hot
    nodes are folded by map-side minima; each round is written to the shared folder.
    """
    now = nearer(edges)
    while not _done(now):
        before, now = now, nearer(now)
        drop_paths(before)
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of an edge (a, b) between longs. No edges: no rows.

    A node with an edge to itself alone is in no component.
    """
    found = stars(edges)
    return found.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(found.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
