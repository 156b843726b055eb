"""Connected components of a link table, by alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import discard, stored

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours v; partial sums go before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: the least node reachable. ``links`` has columns a and b.

    Links may repeat, point either way and form circles; nulls and links to oneself are ignored. Each round joins
    edges with one row a node, so a node with very many links is split by adaptive skew handling, not gathered.
    Rounds grow with the logarithm of the longest path.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(both.join(stored(_least(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = stored(_least(large))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # the edges as a set: their number and a sum of their hashes
        now = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).head()
        discard(large)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
