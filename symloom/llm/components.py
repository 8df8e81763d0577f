"""Connected components by alternating large and small stars (DataFrame joins only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import cut, spread_join


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours. Partial aggregation runs before the shuffle, so a hub is cheap."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, *, rounds: int = 50, most: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the least node of its component.

    Each round rewires every edge to its neighbourhood's least node, and ends when the edges no longer change; the number
    of rounds grows with the logarithm of the longest path. A hub's edges are salted, and split further by AQE. Loops and repeated
    edges are allowed; edges with a null end are dropped; without edges there are no rows. ``most``: a bound of the number of edges, where one is known.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), most)
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    mark, n = None, now.count()
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = spread_join(both, _least(both), "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        m = _least(large)
        small = spread_join(large, m, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u > v").distinct(), n)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark, n = new, new[0]
    else:
        raise RuntimeError(f"components: still changing after {rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
