"""Connected components of links by alternating stars; every round is stored, no node gathers its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    joined = links.join(least, "a")
    tied = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node it is connected with.

    ``links`` has columns a and b of one ordered type; loops and repeated links are allowed, links with a
    null are left out. The number of rounds grows with the logarithm of the longest path.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    mark = _mark(links)
    while True:
        links = stored(_small_star(_large_star(links)), "links")
        previous, mark = mark, _mark(links)
        if mark == previous:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
