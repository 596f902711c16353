"""Connected components of a graph whose edges are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable


def components(edges: DataFrame, label: str = "stars") -> DataFrame:
    """node and root, the least node reachable, for every node of ``edges`` (u, v: long, u != v).

    Rounds of large and small stars: each node hands its greater, then its lesser neighbours to the least one it knows, until
    every component is a star. Minima are aggregated before the shuffle and joined back, so a node with very many neighbours
    is a skewed join, which adaptive execution splits, and never a group held by one task. Each round is written to the shared
    folder, which cuts the lineage.
    """
    stars = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), label)
    before = None
    while True:
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now.n == 0:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = durable(moved.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), label)
