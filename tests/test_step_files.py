"""Step tables: what a job shuffled goes when it ends, and tables that are no longer read can be dropped one by one."""

import os
import time

from pyspark.sql import functions as F

from beadloom.operators import graph
from beadloom.operators import matching as M
from beadloom.plans import matching_queries
from beadloom.session import cut_lineage, drop_step, job_dir


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(k).getName() for k in range(blocks.size()) if blocks.apply(k).getName().startswith("shuffle_")}


def settled(spark, before):
    """New shuffle files once the removals, which run beside the job, are through."""
    for _ in range(50):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


def steps(spark):
    return {f for f in os.listdir(job_dir(spark)) if f.startswith("step-")} if os.path.isdir(job_dir(spark)) else set()


def test_a_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"))
    assert settled(spark, before) == set()
    assert sorted(r["count"] for r in out.collect()) == [142] + [143] * 6


def test_only_the_given_step_is_dropped(spark, tmp_path):
    kept, gone = cut_lineage(spark.range(5)), cut_lineage(spark.range(7))
    spark.range(3).write.parquet(f"{tmp_path}/own.parquet")
    own = spark.read.parquet(f"{tmp_path}/own.parquet")
    n = len(steps(spark))
    drop_step(gone)
    drop_step(own)  # not a step
    assert len(steps(spark)) == n - 1
    assert (kept.count(), own.count()) == (5, 3)


def test_bead_bonds_are_stored_before_they_are_read_twice(spark):
    class T:
        before = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 1, 2)], "frame long, bond_type long, a1 long, a2 long")
        after = spark.createDataFrame([(1, 1, 1, 2), (1, 1, 3, 2), (2, 1, 3, 1)], "frame long, bond_type long, a1 long, a2 long")
        mapping = spark.createDataFrame([(1, 16777217), (2, 16777218), (3, 16777219)], "atom_id long, bead_id long")
        nation = spark.createDataFrame([(0, "A"), (4, "B"), (7, "C")], "n_nationkey int, n_name string")

    out = matching_queries._matches(T)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "raise_error" not in plan  # bonds are not mapped to beads again
    out.collect()


def test_component_rounds_and_template_steps_keep_only_what_is_read(spark):
    n = len(steps(spark))
    bonds = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    roots = graph.component_roots(bonds)
    assert roots.select("root").distinct().count() == 1
    assert len(steps(spark)) == n + 1
    side = "frame long, bond_type long, a1 long, a2 long"
    before, after = spark.createDataFrame([(1, 1, 2, 3)], side), spark.createDataFrame([(1, 1, 2, 3), (1, 1, 2, 1)], side)
    types = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 7)], "frame long, atom_id long, type long")
    edges = M.typed_edges(before, after, types, types)
    assert len(steps(spark)) == n + 2
    atoms = types.select("frame", "atom_id", F.col("type").alias("t0"), F.col("type").alias("t1"))
    templates = spark.createDataFrame(
        [("pair", [(1, 2, False, True)], [(1, 5, 5), (2, 6, 6), (3, 7, 7)])], matching_queries.TEMPLATE_SCHEMA)
    found = M.match_templates(edges, templates, atoms)
    assert [tuple(r) for r in found.collect()] == [(1, "pair", 1, 2, [1, 2, 3])]
    assert len(steps(spark)) == n + 3
