"""Connected components of an edge table, by alternating large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import cut


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of the edges (a, b), root being the smallest end of its component, itself included.

    Minima are partial aggregates, written before they are joined, so that both sides of a join are plain exchanges and
    Spark can split the rows of a hot vertex. Nothing but two numbers a round reaches the driver.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
