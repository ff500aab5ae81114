"""Connected components of a table of links, in rounds of joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludomill.session import settle


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node of ``links`` (a, b), for all but the roots themselves."""
    least = F.min("b").alias("m")
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _digest(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(least).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(least)
        small = large.join(nearest, "a").select(F.explode(F.array(F.col("b"), F.col("a"))).alias("a"), F.col("m").alias("b"))
        edges = settle(small.filter("a <> b").distinct())
        now = _digest(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
