"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortise.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node that it reaches.

    Alternates the large-star and small-star steps until the edge table stands still: then every
    node points at its root. Each round is two partial aggregations and two joins; a hub's rows
    are split by skew-join, and nothing but one row of counts comes to the driver. Self-edges and
    repeated edges count once, edges with a null end are dropped, no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.col("a") != F.col("b")).alias("differ"))
    now = settled(edges.where("differ").select("u", "v").distinct())
    mark = None
    while True:
        # bit_xor and count together tell whether the edge table has changed.
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen[0] == 0 or seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(small.union(least).distinct())
