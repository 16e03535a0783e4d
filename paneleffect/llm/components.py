"""Connected components of a link table, by alternating stars.

Every round joins each node's larger neighbours to its smallest neighbour, then all its smaller
neighbours and itself to the smallest of them (the published large-star and small-star steps),
until only stars are left. Minima are combined before the shuffle, so a node with very many links is
no bottleneck; every round is stored, so the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneleffect.llm.common import stage


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")).distinct())
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.max("up").alias("up")).where("k > 1 and up = 1").isEmpty()


def _round(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v in and out."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has a link; ids are integers.
    Links from a node to itself and repeated links change nothing."""
    high, low = F.greatest(a, b).cast("long"), F.least(a, b).cast("long")
    edges = stage(links.select(high.alias("u"), low.alias("v")).where("u > v").distinct(), "links")
    while not _settled(edges):
        edges = stage(_round(edges), "stars")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
