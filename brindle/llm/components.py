"""Connected components by alternating large-star and small-star rounds.

Edges stay a distributed table: a round is two aggregations and two joins, its result is written to the shared
folder, and only a count and a checksum come to the driver. A hub's edges are never gathered in one task: minima
are pre-aggregated before the shuffle, and the joins are left to adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.storage import cut, drop


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """links: (u, v), all neighbours v of u that the round looks at."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = links.join(least, "u")
    moved = joined.where("v > u") if larger else joined.where("v != m")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def roots(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex that has an edge: the smallest vertex reachable from it.

    edges: columns ``a`` and ``b`` of one orderable type, in any direction, repeats and loops allowed; no edges
    give an empty table.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        then = cut(_star(large, larger=False), "edges")
        after = _state(then)
        drop(now)
        now = then
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
