"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import forget, spread_join, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of the edges (a, b) with the smallest node that each reaches; those that are it themselves have no row.

    Self-loops and repeated edges do no harm; an empty table gives an empty result. Steps go on until nothing changes, which
    takes of the order of log(nodes) squared of them. Each is written to the shared folder; only a count and a checksum reach
    the driver. The centre of a star may hold any share of the edges: heavy nodes are joined without dealing by them.
    """
    now = stored(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _sign(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(spread_join(both, low, "u", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = spread_join(large, large.groupBy("u").agg(F.min("v").alias("m")), "u", 2 * seen[0]).select(F.col("v").alias("a"), F.col("u").alias("b"), "m")
        star = small.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("b").alias("u"), F.col("m").alias("v")))
        before, now = now, stored(star.where("u <> v").distinct())
        forget(before, large)
        new = _sign(now)
        if new == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = new


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
