"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centroidal.llm.common import written

MOST_ROUNDS = 50


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low"))
    lowest = written(lowest.select(F.col("a").alias("b"), F.least("a", "low").alias("low")), "components-low")
    return edges.join(lowest, "b").select("a", F.col("low").alias("b")).filter("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    lowest = written(edges.groupBy("a").agg(F.min("b").alias("low")), "components-low")
    moved = edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
    return moved.union(lowest.select("a", F.col("low").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple[int, int]:
    sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return sums["n"], int(sums["sum"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` with a > b; the root is the smallest node.

    Each round is written to the shared folder, so lineage stays short.  Nodes are joined
    with one row each, so a hub's edges can be split over tasks.  Roots themselves are left out.
    """
    current = written(edges.select("a", "b").distinct(), "components")
    seen = _print(current)
    for _ in range(MOST_ROUNDS):
        current = written(_small(written(_large(current), "components")), "components")
        now = _print(current)
        if now == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("the components did not settle")
