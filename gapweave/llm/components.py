"""Connected components of a graph that no single machine has to hold.

Large star and small star in turn: every node links its larger neighbours, then
its smaller ones, to the smallest node it knows.  The number of rounds grows with
the logarithm of the longest path.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import hand_over


def _with_least(arcs: DataFrame) -> DataFrame:
    """``u, v, m``: arcs with the smallest of u and all its neighbours."""
    least = arcs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return arcs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    starred = _with_least(down)
    moved = starred.filter(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(starred.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that is not itself the smallest of its component."""
    edges = hand_over(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    before, now = None, _stamp(edges)
    while now != before:
        edges = hand_over(_small_star(_large_star(edges)))
        before, now = now, _stamp(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
