"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def _print(edges: DataFrame) -> tuple:
    """An order-free fingerprint of an edge table."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
    )



def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, component)`` per node that has an edge; component is the smallest linked node.

    Every step is a grouped minimum (combined before the shuffle) and a join of the edges with one row
    per node, so a node with very many edges never gathers in one task: the minimum is pre-aggregated
    and the many side of the join can be split.  Edges are written between steps.  Null ends and loops
    are ignored; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = checkpointed(e.where("u <> v").distinct())
    before = _print(e)
    while True:
        # Large star: the larger neighbours of each node move to its smallest neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of each node, and the node, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = checkpointed(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _print(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
