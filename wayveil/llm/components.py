"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one shuffle of at most as many rows as there are links; nothing is collected on
the driver but a count. Hubs are safe: a node's neighbours are never gathered, only their
minimum is (summed map-side), and skewed joins may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v. Large star: every larger neighbour is linked to a node's minimum; small star: every smaller one and the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest member) for each node of ``links`` (u, v: long, not null)."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "cc")
    mark = None
    while True:
        fresh = written(_star(_star(edges, True), False), "cc")
        now = fresh.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        forget(edges)
        edges = fresh
        if now == mark or now[0] == now[2] and _flat(edges):
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _flat(edges: DataFrame) -> bool:
    """Whether no node is both a member and a root."""
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
