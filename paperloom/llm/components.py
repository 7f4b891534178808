"""Connected components of an edge table by alternating large-star and small-star, each round a written table.

Rounds end when the edges are stars whose centres are no one's leaves, which joins find out exactly. Joins to a node with
many neighbours are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A node with at least this many neighbours (and 1/256 of all) is dealt over salts.
HOT_DEGREE = 200


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def hubs(edges: DataFrame) -> common.Hot:
    """Nodes of high degree; a star step never gives a node more smaller neighbours than it had."""
    degrees = both_ways(edges).groupBy("a").agg(F.count("*").alias("n"))
    return common.hot_keys(degrees, "a", "n", 2 * edges.count(), HOT_DEGREE)


def large_star(edges: DataFrame, hot: common.Hot) -> DataFrame:
    """Larger neighbours of a node go to its least neighbour (or itself)."""
    both = both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return common.join_one(both.where("b > a"), least, "a", hot, "b", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame, hot: common.Hot) -> DataFrame:
    """A node and its smaller neighbours go to the least of them. Edges have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = common.join_one(edges, least, "a", hot, "b", "inner").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether each node is the leaf of one centre at most and no centre is a leaf."""
    if not edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    centres = edges.select(F.col("b").alias("a")).distinct()
    return edges.join(centres, "a", "left_semi").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(a, b): each node that isn't its component's least, and that least node. Every round is a written table."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.written(ordered, "edges")
    while not are_stars(now):
        hot, old = hubs(now), now
        now = common.written(small_star(large_star(old, hot), hot), "edges")
        common.discard(old)
    return now
