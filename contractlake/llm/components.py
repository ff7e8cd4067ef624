"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlake.llm.common import stage


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(u, root) for every node of `links` (u, v): root is the least node of its component.

    Each round joins every edge with the least neighbour of its end; no list of neighbours is ever
    gathered, so hubs are harmless. Rounds grow with the logarithm of a component's length.
    """
    edges = stage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(limit):
        now = _state(edges)
        if now == before or not now[0]:
            break
        before = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.filter("u <> v"), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = edges.select("u", F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
