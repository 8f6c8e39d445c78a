"""Connected components of a link table, by alternating large and small stars.

Every step is a grouped minimum and a join, the links written to the shared scratch
folder in between; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import scratch_table


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    around = _both_ways(links)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b")))


def _print_of(links: DataFrame) -> tuple:
    """What tells one set of links from another: their number and the sum of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every node that has a link: the smallest id it reaches."""
    current = scratch_table(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while (now := _print_of(current)) != before:
        before = now
        # A step has at most twice the links it begins with.
        step = _small_star(_large_star(current)).where("a <> b").distinct()
        current = scratch_table(step, "links", rows=2 * now[0])
    stars = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
