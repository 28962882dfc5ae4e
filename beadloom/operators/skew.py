"""Lookups whose keys may be skewed, with a broadcast of proven size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_SHARE = 512


def hot_keys(fact: DataFrame, key: str) -> DataFrame:
    """Keys holding more than 1/512 of the rows: fewer than 512 of them, whatever the data."""
    counts = fact.groupBy(F.col(key).alias("_hk")).agg(F.count(F.lit(1)).alias("_n"))
    total = fact.agg(F.count(F.lit(1)).alias("_t")).scalar()
    return counts.where(F.col("_n") * F.lit(HOT_SHARE) > total).select("_hk")


def lookup(fact: DataFrame, key: str, dim: DataFrame, dim_key: str, hot: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """Left join to a table with at most one row per key.

    Rows of hot keys take a broadcast of those few dimension rows, all others a
    shuffled join, so that no task receives a whole hot key. The fact side is read
    several times: it is written once first, unless it is ``stored`` already.
    """
    if hot is None:
        fact = fact if stored else cut_lineage(fact)
        hot = hot_keys(fact, key)
    named = dim.withColumnRenamed(dim_key, "_dk")
    hot_dim = F.broadcast(hot.join(named, F.col("_hk") == F.col("_dk"), "left").drop("_dk"))
    cold = fact.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left_anti")
    cold = cold.join(named, F.col(key) == F.col("_dk"), "left").drop("_dk")
    warm = fact.join(hot_dim, F.col(key) == F.col("_hk")).drop("_hk")
    return cold.unionByName(warm)


def per_group(fact: DataFrame, dim: DataFrame, group: list[str], stored: bool = False) -> DataFrame:
    """Join an aggregate back by group without piling a big group into one task."""
    tagged = fact.withColumn("_g", F.struct(*group))
    named = dim.withColumn("_gk", F.struct(*group)).drop(*group)
    return lookup(tagged, "_g", named, "_gk", stored=stored).drop("_g")
