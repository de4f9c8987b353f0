"""Connected components by alternating large-star and small-star, as joins and sums.

Each step finds the least neighbour of every node with a grouped minimum (summed map-side) and joins
it back, so that a hub with most of all edges is no group in one task: the join's large side can be
split. The edges are written to the shared folder after each round, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges go from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the least node reachable.

    Edges have no direction; loops and repeated edges count once, edges with a null end not at all.
    A node that has only loops is not returned.
    """
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    kept = start.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") > F.col("v")))
    current = materialize(kept.select("u", "v").distinct(), "edges")
    before = _state(current)
    while before[0]:
        current = materialize(_small_star(_large_star(current)), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
