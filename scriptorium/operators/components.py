"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (partially aggregated before the shuffle) and an
equi-join that AQE can split where a hub has many edges; edge lists never meet in
one task.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v, giving edges of the same kind."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges
    lowest = both.groupBy("u").agg(F.min("v").alias("low"))
    if large:
        lowest = lowest.select("u", F.least("u", "low").alias("low"))
        moved = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = moved.union(lowest.select("u", F.col("low").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now, mark = cut(pairs, "edges"), None
    while True:
        step = cut(_star(_star(now, True), False), "edges")
        drop_cut(now)
        now = step
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
