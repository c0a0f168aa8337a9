"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is a pair of grouped minima over the edges. Between rounds the
edges are written to the shared folder, so a lost executor costs one round.
A node with a very large neighbourhood is grouped with map-side minima. The
minima are written before they join the edges, so that the join shuffles both
sides and AQE can split such a node's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import moved, release, saved

MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool, scope: str) -> DataFrame:
    """Large star links a node's larger neighbours to the least of its neighbourhood, small star its smaller ones and itself."""
    if large:
        pairs = _both_ways(edges)
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = saved(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), scope)
    joined = pairs.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, scope: str = "session") -> DataFrame:
    """(node, root): every node that has an edge, and the least node of its component. edges has columns a and b."""
    current = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scope)
    before = None
    for turn in range(MAX_ROUNDS):
        own = f"{scope}-components-{turn}"
        following = saved(_star(saved(_star(current, True, own), own), False, own), own)
        # settled when no edge has changed: count and two independent sums of a hash of each edge
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.hash("b", "a").cast("long"))).head()
        if turn:
            release(edges.sparkSession, f"{scope}-components-{turn - 1}")  # current's tables
        current = following
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    moved(f"{scope}-components-{turn}", scope)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
