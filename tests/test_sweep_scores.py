"""The sweep scores all tries of a curve at once, by the rules of the operators for single curves."""

import math

import pytest
from pyspark.sql import functions as F

from beadloom.operators import curves as C


def curves(spark):
    rows = []
    for c in range(4):
        for k in range(40):
            bump = math.exp(-((k - 12 - c) / 4.0) ** 2) + 0.6 * math.exp(-((k - 28) / 5.0) ** 2)
            rows.append((c, k, 1.0 + 0.5 * k, None if c == 3 and k == 17 else 0.1 * bump + 0.004 * (k * (c + 3) % 5)))
    rows += [(None, k, 1.0 + 0.5 * k, 0.1) for k in range(9)]
    return spark.createDataFrame(rows, "curve_id long, i long, x double, p double")


def scored(df, small, large, order, factor):
    """Score of one try by joins and windows."""
    prepared = C.with_valid_range(df)
    peaks = C.detect_peaks(prepared, "p")
    arrays = C.to_arrays(prepared)
    for name, f in (("s", small), ("l", large)):
        arrays = arrays.withColumn(name, C.savgol_smooth("ps", C.odd_window(int(f * 7), order), order))
    long = C.from_arrays(arrays, ["ps", "s", "l"]).withColumnRenamed("ps", "p").join(prepared.select("curve_id", "i", "i_start", "i_end"), ["curve_id", "i"])
    long = C.with_zones(long, peaks, C.peak_width(prepared, peaks), "bond", factor)
    zone = F.col("zone")
    picked = F.when(zone == 1, F.col("s")).when(zone.isin(2, 3), F.col("l")).otherwise(F.col("p"))
    tried = C.average_zone_borders(long.withColumn("ps", F.greatest(F.lit(0.0), picked)), "ps")
    return {r["curve_id"]: r["score"] for r in C.smoothing_quality(tried, raw_curves=prepared, raw_keys=["curve_id"]).collect()}


def test_scores_are_those_of_the_rules_and_the_best_is_taken(spark):
    df = curves(spark)
    grid = {"small": [0.5, 1.3], "large": [3.1], "order": [2, 4], "width": [1.0]}
    wanted = {(a, 3.1, o, 1.0): scored(df, a, 3.1, o, 1.0) for a in grid["small"] for o in grid["order"]}
    got = C.sweep_smoothing(df, grid=grid)
    assert got.columns == ["curve_id", "small", "large", "order", "peak_factor", "score"]
    rows = {r["curve_id"]: r for r in got.collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    for c, r in rows.items():
        best = max(by[c] for by in wanted.values())
        assert r["score"] == pytest.approx(best, rel=1e-12)
        assert wanted[r["small"], r["large"], r["order"], r["peak_factor"]][c] == pytest.approx(best, rel=1e-12)


def test_tries_are_not_rows(spark):
    plan = C.sweep_smoothing(curves(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "peak_factor" in plan and "Generate inline" not in plan
