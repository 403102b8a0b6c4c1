"""Connected components by alternating large-star and small-star steps.

Both steps are a minimum per node, which Spark pre-aggregates before the shuffle, and a look-up of it for each link. No neighbour
list is ever gathered, and the minima of the nodes with the most links, a bounded number of them, are broadcast, so a node's links
stay where they are however many they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import let_go, looked_up, saved


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest node in the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n_"))
    return looked_up(both.where("b > a"), least, "a", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked with the smallest one. In: b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_"))
    moved = looked_up(edges, least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b of longs, in either order, self-links ignored).

    component is the smallest node that can be reached. Nulls are ignored; an empty table gives an empty one. Lineage is cut
    with checkpoint() after each round, so a lost executor costs one round at most; shuffle files of the rounds before are deleted.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total = edges.count()
    before = None
    for _ in range(rounds if total else 0):
        # links of a step are no more than those before it and a link per node
        edges = saved(_small_star(_large_star(edges, total), 2 * total))
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        total = mark[0]
        let_go(edges.sparkSession)
        if mark == before:
            break
        before = mark
    else:
        if total:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
