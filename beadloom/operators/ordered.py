"""Numbering and prefix sums that never put a whole group into one task.

A plain window over a key works in one task per key. Where a key may hold a
large share of the rows, the rows of a key are cut into ordered buckets: sizes
are aggregated per (key, bucket), prefix-summed over the few buckets, and the
numbering inside a bucket is offset by that sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import hot_keys


def bucketed_row_number(df: DataFrame, keys: list[str], bucket, order: list, name: str) -> DataFrame:
    """row_number over (keys order by bucket, order), computed per (key, bucket).

    ``bucket`` is an integer Column with few values per key.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_in_bucket", F.row_number().over(inner))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_in_bucket") + F.col("_before"))
        .drop("_bucket", "_in_bucket", "_before")
    )


def keyed_row_number(df: DataFrame, key: str, bucket, order: list, name: str) -> DataFrame:
    """``bucketed_row_number`` for one key, with a single shuffle of the rows: only keys with more than 1/512 of them are cut into buckets.

    ``df`` is read three times, so it should be a table. Rows without a key are left out, as are those without a bucket, which are counted first.
    """
    tagged = df.withColumn("_bucket", bucket).where(F.col(key).isNotNull())
    hot = F.broadcast(hot_keys(tagged, key))
    sizes = tagged.select(key, "_bucket").join(hot, F.col(key) == F.col("_hk")).groupBy("_hk", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_hk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a few buckets of fewer than 512 keys
    offsets = sizes.select(F.col("_hk").alias("_k"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    cut = tagged.join(hot, F.col(key) == F.col("_hk"), "left").withColumn("_cut", F.when(F.col("_hk").isNotNull(), F.col("_bucket"))).drop("_hk")
    inner = Window.partitionBy(key, "_cut").orderBy("_bucket", *order)
    numbered = cut.withColumn("_in_bucket", F.row_number().over(inner))
    return (
        numbered.where("_bucket IS NOT NULL").join(F.broadcast(offsets), (F.col(key) == F.col("_k")) & (F.col("_cut") == F.col("_b")), "left")
        .withColumn(name, F.col("_in_bucket") + F.coalesce("_before", F.lit(0)))
        .drop("_bucket", "_in_bucket", "_before", "_cut", "_k", "_b")
    )


def dense_index(df: DataFrame, column: str, name: str, buckets: int = 256) -> DataFrame:
    """Distinct values of ``column`` numbered 1.. in ascending order, no global window.

    Quantile bounds (at most ``buckets`` numbers, one row) cut the values into
    ranges; each range is numbered on its own and shifted by the sizes before it.
    """
    values = cut_lineage(df.select(column).where(F.col(column).isNotNull()).distinct())
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = values.agg(
        F.array_distinct(F.percentile_approx(column, probs, F.lit(10000))).alias("_bounds")
    ).scalar()
    cut = values.withColumn("_bounds", bounds).withColumn(
        "_b", F.size(F.filter("_bounds", lambda b: b < F.col(column)))
    ).drop("_bounds")
    return bucketed_index(cut, "_b", column, name)


def bucketed_index(values: DataFrame, bucket: str, column: str, name: str) -> DataFrame:
    sizes = values.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # at most a few hundred rows
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inner = Window.partitionBy(bucket).orderBy(column)
    return (
        values.withColumn("_rn", F.row_number().over(inner))
        .join(F.broadcast(offsets), bucket)
        .select(column, (F.col("_rn") + F.col("_off")).alias(name))
    )


def blocked_running_sum(
    df: DataFrame, keys: list[str], order: str, values: list[str], block: int = 4096, suffix: str = "_cum"
) -> DataFrame:
    """Running sums over (keys order by order), cut into blocks of the integer order column."""
    tagged = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    sums = tagged.groupBy(*keys, "_blk").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_blk", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inner = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(offsets, [*keys, "_blk"])
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.sum(v).over(inner) + F.col(f"_o_{v}"))
    return out.drop("_blk", *[f"_o_{v}" for v in values])
