"""Bonded pairs are left out where neighbours meet; the neighbour pairs are not shuffled for it."""

from pyspark.sql import functions as F

from beadloom.operators import bonds, spatial
from beadloom.plans.catalogue import QUERIES


def test_excluded_pairs_go_without_a_shuffle_of_the_pairs(spark, tmp_path):
    points = [(0, 1, 1.0), (0, 2, 1.5), (0, 3, 9.9), (0, 3, 9.9), (0, 4, 2.5), (0, 5, 5.0), (1, 1, 5.0), (1, 4, 5.5)]
    beads = spark.createDataFrame(points, "frame long, bead_id long, x double").withColumns({"y": F.lit(1.0), "z": F.lit(1.0)})
    out = spark.createDataFrame([(2, 1), (3, 4), (3, 4), (None, 4), (7, None)], "lo long, hi long")
    once = F.col("l_bead_id") < F.col("r_bead_id")
    pairs = spatial.neighbour_join(bonds.with_excluded(beads, out, "bead_id"), beads, ["frame"], 10.0, 2.7, condition=once, half=True)
    near = bonds.drop_excluded(pairs.where("l_bead_id <> r_bead_id"), "l_excluded", "r_bead_id")
    got = sorted((x.frame, *sorted((x.l_bead_id, x.r_bead_id))) for x in near.collect())
    assert got == [(0, 1, 3), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 3), (0, 2, 4), (0, 4, 5), (1, 1, 4)]
    spark.range(1, 101).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    plan = QUERIES["jn13_bonded_exclusions"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
