"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.storage import ROWS_A_FILE, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hung_on_least(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Neighbours of each node (all, or the larger ones) linked to the least node around it."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    moved = pairs.join(least, "a")
    if larger_only:
        moved = moved.where(F.col("b") > F.col("a")).select("b", "least")
    else:
        own = least.select(F.col("a").alias("b"), "least")
        moved = moved.select("b", "least").unionByName(own)
    return moved.where(F.col("b") != F.col("least")).select(F.col("least").alias("a"), "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in (a, b): the component is its least node.

    Large-star and small-star steps take turns until nothing moves; every step is a grouped minimum and a join, and its
    edges are written, so that a lost executor repeats one step at most. No step adds edges, so each is written in as many files as
    the edges before it need.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(edges)
    while True:
        large = _hung_on_least(_both_ways(edges), larger_only=True)
        # small star: from each node to its smaller neighbours
        edges = stored(_hung_on_least(large.select(F.col("b").alias("a"), F.col("a").alias("b")), larger_only=False), "edges", seen[0])
        now = mark(edges)
        if now == seen:
            break
        seen = now
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    both = members.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    return both.coalesce(2 * seen[0] // ROWS_A_FILE + 1)
