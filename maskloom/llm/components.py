"""Connected components of an edge table by alternating large and small stars.

Every round is two shuffles of at most the edges; a hub is pre-aggregated to its minimum before
the shuffle, and the join that brings it back splits skewed keys (adaptive execution). Rounds end
when the edges are stars around their smallest nodes, after about the logarithm of the longest path;
telling so takes one aggregation, so edges that are stars from the start need no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs); component is its smallest node."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stash(pairs, "edges")
    while not _stars(pairs):
        pairs = stash(_small_star(_large_star(pairs)), "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))


def _stars(pairs: DataFrame) -> bool:
    """Whether every ``u`` has one edge and is nobody's ``v``. As u > v, each v is then its component's smallest node."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return seen.filter("ups > 1 OR (ups > 0 AND least = 0)").isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


class Forest:
    """Union and find over numbers that join towards the smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were apart; they aren't any more."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b
