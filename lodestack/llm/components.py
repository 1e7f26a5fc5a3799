"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated) and an equi-join on the node,
which adaptive execution splits where a node is hot. Every round is written to
the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return tuple(row)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b); the root is the component's least node.

    Self-links, repeated links and links with a null end add nothing; no links
    give an empty table.
    """
    stars = work.save(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = _mark(stars)
    while mark[0]:
        after = work.save(_small_star(_large_star(stars)))
        work.drop(stars)
        stars, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root"))
