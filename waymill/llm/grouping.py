"""Pairwise matches consolidated into groups: giant component peeled first, the rest by minimum propagation.

The vertex of the highest degree starts a breadth-first search whose frontiers are joined with the edges. A frontier is
anti-joined away from the edges as soon as it has been expanded, and the edges that are left are rewired by one round of
minimum propagation before the next frontier: their components stay, but distances within them shrink, so the search
exhausts its component in a number of rounds logarithmic in the longest chain, whatever its shape.

What is left then holds no vertex of the giant component and is labelled by further rounds of minimum propagation
(every vertex links its larger neighbours, then its smaller ones, to the least vertex it sees). Every round aggregates a
minimum per vertex before the shuffle; no neighbourhood is ever collected. Round tables go to the shared folder, so that
a lost executor costs no more than a stage, and old ones are deleted.

Joins of a round read both sides from written tables, so AQE splits what a hot vertex receives.

Rows with a null world stand in a world of their own. Sides that are null or no 64-bit number take no part; self
matches give a group of one; repeated and reversed rows count once. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.keys import uid, uid_of_rank, uid_rank, world
from waymill.operators.graph import both_ways, least_labels, rewired
from waymill.session import Scratch


def _peel(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame, int]:
    """(vertices of the component of the vertex of the highest degree with their least one as root, the edges that are
    left, rounds made). edges: (w, a, b), a > b, each once."""
    degree = both_ways(edges).groupBy("w", "a").agg(F.count(F.lit(1)).alias("n"))
    top = degree.agg(F.max(F.struct("n", "w", "a")).alias("t")).select("t.w", "t.a").filter("a IS NOT NULL")
    frontier = scratch.write(top, "frontier-0")
    if frontier.isEmpty():
        return None, edges, 0
    giant, k = frontier, 0
    while True:
        k += 1
        new = both_ways(edges).join(frontier, ["w", "a"]).select("w", F.col("b").alias("a")).distinct()
        new = scratch.write(new.join(frontier, ["w", "a"], "left_anti"), f"frontier-{k}")
        left = edges
        for side in "ab":
            gone = frontier.select("w", F.col("a").alias(side))
            left = left.join(gone, ["w", side], "left_anti")
        left = scratch.write(left.select("w", "a", "b"), f"left-{k}")
        if new.isEmpty():
            break
        giant, frontier = giant.unionByName(new), new
        edges = rewired(left, scratch, k)
        scratch.drop(f"left-{k}")
        if k > 1:
            scratch.drop(f"rewired-{k - 1}")
    root = giant.agg(F.min("a")).first()[0]
    return scratch.write(giant.withColumn("root", F.lit(root).cast("bigint")), "giant"), left, k


def connected_groups(pairs: DataFrame) -> DataFrame:
    """(w, a, root) for every vertex of pairs (w, a, b): root is the least vertex of its group.

    w is a text, a and b are BIGINTs whose order is the order of the result.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    pairs = pairs.filter("a IS NOT NULL AND b IS NOT NULL").select("w", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = scratch.write(pairs.distinct(), "pairs")
    giant, left, k = _peel(pairs.filter("a <> b"), scratch)
    labels = least_labels(left, scratch, k + 1)
    if giant is not None:
        labels = labels.unionByName(giant.select("w", "a", "root"))
    every = both_ways(pairs).select("w", "a").distinct()
    return every.join(labels, ["w", "a"], "left").select("w", "a", F.coalesce("root", "a").alias("root"))


def group_matches(matches: DataFrame) -> DataFrame:
    """(map_name, road_feature, group_feature) of every road in a match with both sides."""
    pairs = matches.select(world("map_name").alias("w"), uid_rank(uid("feature_a")).alias("a"), uid_rank(uid("feature_b")).alias("b"))
    out = connected_groups(pairs)
    return out.select(F.col("w").alias("map_name"), uid_of_rank("a").alias("road_feature"), uid_of_rank("root").alias("group_feature"))
