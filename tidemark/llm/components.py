"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v of type long) to (node, root): root is the smallest node of the component.

    Every round shortens all paths, so the rounds grow with the logarithm of the longest one. Each
    round is a written table; nothing is gathered by the driver but a count and a checksum.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = _star(both.where("v > u"), least).distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, least).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "edges")
