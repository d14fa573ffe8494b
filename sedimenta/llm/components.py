"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations and two joins on the links alone; rounds grow with the logarithm of the longest path.  Links stay in
tables in the shared folder; only one number a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, discard, materialised, with_one


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself); n: number of edges."""
    near = both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return linked(near.filter("b > a"), least, n)


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, are linked to the smallest of them; edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return linked(edges, least, n, least.select("a", F.col("m").alias("b")))


def linked(edges: DataFrame, least: DataFrame, n: int, more: DataFrame | None = None) -> DataFrame:
    """(b, m) for each edge (a, b), m being the least of a: the root of a large component has as many edges as that has nodes."""
    if 2 * n > MOST_BROADCAST:
        edges, least = materialised(edges), materialised(least)
    out = with_one(edges, least, "a", 2 * n if 2 * n <= MOST_BROADCAST else None).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (out if more is None else out.unionByName(more)).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of the links (a, b), both long; a node that is its own root is left out."""
    now = materialised(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, n = None, now.count()
    while True:
        larger = large_star(now, n)
        if n > MOST_BROADCAST:
            larger = materialised(larger)
        then = materialised(small_star(larger, n))
        discard(now)
        now = then
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, n = (row["n"], row["h"]), row["n"]
