"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

ROUNDS = 60
#: edges up to which the table of smallest neighbours is broadcast (16 bytes each)
BROADCAST_EDGES = 500_000


def sized(least: DataFrame, few: bool, label: str) -> DataFrame:
    """Broadcast while small; else staged, so that Spark can split the join at a node with very many neighbours."""
    return F.broadcast(least) if few else stage(least, label)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node in edges (u, v: long); component is the smallest node. Each round is staged, and
    stars shrink by partial aggregation, so that no node's neighbours meet in one task."""
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    for _ in range(ROUNDS):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        few = now[0] <= BROADCAST_EDGES
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(sized(least, few, label), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        least = sized(least, few, label)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
