"""Rows that an explode makes of a small table are not collected on the driver for a broadcast."""

import pytest
from pyspark.sql import functions as F

from beadloom.plans import catalogue
from beadloom.sources import dump


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["jn23_bonded_terms", "st7_lj_search", "win19_curve_features"])
def test_exploded_tables_are_joined_by_shuffles(spark, tmp_path, name):
    spark.range(40).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 6).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    plan = plan_of(df)
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert df.count() > 0


def test_lines_stay_where_they_are_when_pieces_are_named(spark):
    lines = spark.range(1, 301).select((F.col("id") % 1 + 7).alias("timestep"), "id", F.lit(dump.BODY).alias("part"), F.lit("x").alias("line"))
    named = dump.with_pieces(lines, "timestep", size=100)
    plan = plan_of(named)
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert {(r["piece"], r["n"]) for r in named.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        (f"{0:010d}-{1:016d}-{k:08d}", 100) for k in range(3)}
