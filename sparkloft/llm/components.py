"""Connected components of links, by alternating large-star and small-star steps.

Each step is a grouped minimum (found in the map stage) and a join; edges point to ever smaller ids until every
component is a star around its smallest id. A step's edges and minima are kept in the shared folder, so lineage stays short
and both sides of the join are stored: the edges of a node with very many are split by Spark's skew join.

Each step's tables are kept in as many parts as the number of edges asks for, however many partitions a shuffle has: a step writes
files by edges, not by partitions.

Defined results: an edge from an id to itself tells nothing; repeated edges count once; no edges, no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, functions as F

from sparkloft.sources.tables import durable


#: Edges that a stored part holds, about.
PART = 20_000


def _large_star(edges: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """edges: a, b (any order). One row per id that has a link: id and root, the smallest id of its component."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = durable(edges), None
    parts = max(1, ceil(edges.count() / part))
    stored = lambda rows: durable(rows.coalesce(parts))
    edges = edges.coalesce(parts)
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, edges = now, stored(_small_star(stored(_large_star(edges, stored)), stored))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
