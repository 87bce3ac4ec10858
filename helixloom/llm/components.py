"""Connected components of a graph of links, by alternating large and small stars.

Each round is two aggregations that Spark combines before shuffling and two joins that it can split; the links
of a round are stored, so a lost executor costs at most one round. No node's neighbours meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    tied = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
    return tied.unionAll(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node and root (the smallest node that it is linked to) of every node of links (a, b), a < b, no nulls."""
    links = common.stored(links.distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        after = common.stored(_small_star(_large_star(links)), "links")
        now = mark(after)
        common.forget(links)
        links = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
