"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import kept, scratch, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of ``links`` (a, b: long).

    Large stars (every larger neighbour of a node is linked to the node's smallest neighbour)
    and small stars alternate until nothing changes. Each step is an aggregation
    combined before its shuffle and a join of two stored tables, so a node with a third of all links is
    split; nothing but a count and a checksum reaches the driver.
    """
    # a > b in all edges
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        with scratch(links.sparkSession):
            near = _both_ways(edges)
            least = stored(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "nearest")
            large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = stored(large, "large-stars")
            least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "nearest")
            joined = large.join(least, "a")
            small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            edges = kept(small.distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
