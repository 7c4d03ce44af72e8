"""Connected components by alternating large and small stars, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame) -> DataFrame:
    """links (a, b), each in the direction wanted: every b of an a gets a link to the smallest of a and its bs."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node that a link (a, b) names; root is the component's smallest node.

    Each round is a grouping with partial minima and a join that adaptive execution may split, so a node with very
    many links doesn't gather them in one task. Links from a node to itself, repeated links and null ends are
    harmless. No links give no rows. Rounds grow with the logarithm of the longest path.
    """
    links = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    links = common.materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        links = common.materialize(small.filter("a > b").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        # A forest of stars: every node has one link, and none of the roots has one.
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
