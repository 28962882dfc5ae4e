"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def component_ids(edges: DataFrame) -> DataFrame:
    """(node, component_id): for every node of ``edges`` (a, b long), the smallest node it reaches.

    Every round sends each node to the neighbour, or itself, of the smallest rank. Ranks are the ids in the
    first round, which settles stars around their smallest node, and hashes that change from round to round
    after it, so chains and rings shrink by a constant factor. Stops when no edge is left.
    Nulls take no part; loops and repeated edges are allowed; no edges give no rows.
    """
    edges = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    edges = edges.where("a != b")
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(turn)) if turn else F.col(c)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        step = cut_lineage(both.groupBy("v").agg(F.least(F.min(rank("w")), F.min(rank("v")))["id"].alias("to")))
        a, b = step.toDF("a", "a2"), step.toDF("b", "b2")
        moved = edges.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = cut_lineage(moved.where("a != b").distinct())
        roots = roots.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        turn += 1
    roots = cut_lineage(roots)
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    return roots.join(least, "root").select("node", "component_id")
