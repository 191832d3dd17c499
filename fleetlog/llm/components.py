"""Connected components of a links table, by alternating large and small stars.

Every round is two joins on (u, minimum neighbour) of a staged table; nothing is collected but two
numbers that tell when the table stops changing. A hub's links are spread by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "hub"))
    moved = near.join(least, near.u == least.hub)
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select("v", "m").union(least.select(F.col("hub").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``links`` (u, v) but the smallest of each component."""
    links, before = stage(links.filter("u <> v").distinct(), "links"), None
    for _ in range(rounds):
        links = stage(star(star(links, True), False), "stars")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
