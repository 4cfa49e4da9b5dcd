"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round only groups and joins edges, so no component is ever in one task.
Edges are kept in the reliable checkpoint folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixfold.llm.common import checkpointed


def _only_stars(e: DataFrame) -> bool:
    """Every node has one edge down, to a node that has none."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return found.where("up > 1 or up = 1 and root = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is its smallest node.

    Loops, repeated edges and both directions are fine; edges with a null end
    are left out.  An empty table gives an empty result.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpointed(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _only_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())
