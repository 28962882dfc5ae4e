"""Work that a few keys, a small file or well compressed rows would put into a few tasks is dealt to all of them."""

import datetime

from pyspark.sql import functions as F

from beadloom.operators import curves, graph, matching, ordered
from beadloom.operators.bonds import atom_bonds_to_bead_bonds
from beadloom.plans.fixtures import Inputs
from beadloom.sources import curve_files, tables
from beadloom.sources.curve_files import potential_lines
from beadloom.streaming import monitor


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lineitem(spark, path):
    row = (3, 7, 2, 1, 5.0, 10.0, 0.0, 0.0, "N", "O", datetime.datetime(1996, 1, 1))
    rows = [row, row, (3, 8, *row[2:]), (4, 9, *row[2:])]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, f"{names}, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")


def test_bead_bonds_keep_the_number_of_tasks(spark):
    bonds = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2), (2, 2, 3)], "frame long, a1 long, a2 long")
    mapping = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "atom_id long, bead_id long")
    out = atom_bonds_to_bead_bonds(bonds, mapping)
    assert "REPARTITION_BY_NUM" in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [(1, 10, 11, 1), (2, 10, 11, 1)]


def test_atoms_are_numbered_once(spark, tmp_path):
    lineitem(spark, tmp_path)
    t = Inputs(spark, str(tmp_path))
    assert "Window" not in plan_of(t.mapping.join(t.bonds.withColumnRenamed("a1", "atom_id"), "atom_id"))
    assert sorted((x.mol_id, x.pos) for x in t.atoms.collect()) == [(3, 1), (3, 2), (3, 3), (4, 1)]


def test_tables_of_a_small_file_are_made_in_many_tasks(spark, tmp_path):
    spark.range(1, 101).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 101).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    t = Inputs(spark, str(tmp_path))
    for table, rows in ((t.potentials, 20_000), (t.beads, 300)):
        assert table.rdd.getNumPartitions() >= 8 and table.count() == rows


def test_unsampled_points_are_not_exported(spark):
    u = [1.0, None, float("nan"), float("inf"), 2.0, -1e301, 3.0]
    rows = spark.createDataFrame([("pair_1", "pair", i, 1.0 + i, v) for i, v in enumerate(u)], "name string, kind string, i long, x double, u double")
    out = potential_lines(rows)
    assert sorted(float(x.line.split()[2]) for x in out.where("part = 9").collect()) == [1.0, 2.0, 3.0]


def test_a_frame_of_a_pair_is_not_gathered(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "pairs")
    spark.range(600).select(F.lit(0).cast("long").alias("run"), F.lit(1).cast("long").alias("timestep"), F.col("id").alias("atom_id")).repartition(6).write.parquet(landed)
    changes = spark.createDataFrame([(0, 1), (0, 2), (0, 9)], "run long, timestep long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monitor.frame_pairs_sink(landed, 1, out)(changes, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pairs = spark.read.parquet(out)
    assert {(x.event, x.side, x.n) for x in pairs.groupBy("event", "side").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, "after", 600), (2, "before", 600)}
    assert len(pairs.inputFiles()) > 1


def test_small_files_are_written_by_many_tasks_and_opened_once(spark, tmp_path):
    curves = spark.range(200).select(
        F.format_string("bond_%d.dist.tgt", F.floor(F.col("id") / 2)).alias("name"), (F.col("id") % 2).alias("i"), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.5).alias("p"))
    curve_files.write_distributions(curves, str(tmp_path / "dist"))
    assert len({file.name.split("-")[1] for file in (tmp_path / "dist").glob("name=*/part-*")}) > 1
    out = curve_files.read_distributions(spark, str(tmp_path / "dist"))
    assert "FileScan text" not in plan_of(out)
    assert sorted((int(x.types), x.i, x.x, x.p, x.step) for x in out.collect()) == [(k // 2, k % 2, float(k % 2), 0.5, 1.0) for k in range(200)]


def test_data_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "one.data").write_text("# system\n2 atoms\n0.0 5.0 xlo xhi\n\nMasses\n\n1 2.5 # A\n\nAtoms # molecular\n\n1 7 1 0.5 1.5 2.5\n2 7 1 3.5 4.5 0.25\n\nBonds\n\n1 3 1 2\n")
    parts = tables.read_data_file(spark, str(tmp_path))
    assert not any("MapInArrow" in plan_of(part) for part in parts.values())
    assert sorted(tuple(x)[1:] for x in parts["atoms"].collect()) == [(1, 7, 1, 0.5, 1.5, 2.5), (2, 7, 1, 3.5, 4.5, 0.25)]
    assert [tuple(x)[1:] for x in parts["bonds"].collect()] == [(3, 1, 2)] and [tuple(x)[1:] for x in parts["box"].collect()] == [("x", 0.0, 5.0)]


def test_states_are_joined_once_for_a_cross_check(spark):
    expected = spark.createDataFrame([(1, k, k % 3) for k in range(9)] + [(2, 1, None)], "frame long, atom_id long, bead_type long")
    recorded = spark.createDataFrame([(1, k, 1) for k in range(9)] + [(2, 1, 1)], "frame long, atom_id long, bead_type long")
    out = matching.cross_check(expected, recorded, 2)
    assert plan_of(out).count("Join") <= 2  # the lists, in the first and the final plan
    assert sorted(map(tuple, out.collect())) == [(1, 9, 6, "0,2"), (2, 1, 0, None)]


def test_degrees_of_some_edges_count_all(spark):
    rows = [(1, 1, 2, True, False), (1, 2, 1, True, False), (1, 1, 3, True, True), (1, 3, 1, True, True)]
    edges = spark.createDataFrame(rows, "frame long, u long, v long, in_before boolean, in_after boolean")
    out = matching.with_degrees(edges, edges.where("u = 1 AND v = 3"))
    assert [(x.u, x.v, x.du0, x.du1, x.dv0, x.dv1) for x in out.collect()] == [(1, 3, 2, 1, 1, 1)]


def test_bonds_of_a_frame_are_not_gathered_by_its_size(spark, tmp_path, monkeypatch):
    sent = []
    monkeypatch.setattr(tables.F, "broadcast", lambda df: sent.append(df.columns) or df)
    bonds = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 3)], "frame long, bond_type long, a1 long, a2 long")
    tables.write_reaction_frames(bonds, bonds.where("a1 = 1"), str(tmp_path / "frames"))
    assert ["frame", "_blocks"] in sent
    got = {side: sorted(map(tuple, tables.read_reaction_frames(spark, str(tmp_path / "frames"), side).collect())) for side in ("bonds_before", "bonds_after")}
    assert got == {"bonds_before": [(1, 1, 1, 2), (1, 2, 2, 3)], "bonds_after": [(1, 1, 1, 2)]}


def test_curves_are_smoothed_once_for_all_readers(spark):
    rows = spark.range(6).select(F.lit(1).cast("long").alias("curve_id"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"), F.lit(0.2).alias("p"))
    for kind in ("bond", "angle", "dihedral", "rdf"):
        plan = plan_of(curves.smooth_distributions(rows, kind))
        assert "Generate" not in plan and "Range" not in plan


def test_atoms_are_numbered_without_columns_that_make_no_difference(spark, tmp_path):
    lineitem(spark, tmp_path)
    from beadloom.plans import fixtures

    columns, plain = [], fixtures.keyed_row_number
    fixtures.keyed_row_number = lambda df, *rest: columns.extend(df.columns) or plain(df, *rest)
    try:
        assert Inputs(spark, str(tmp_path)).atoms.count() == 4
    finally:
        fixtures.keyed_row_number = plain
    assert set(columns) == {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"}


def test_numbers_of_hot_and_other_keys_match_a_plain_window(spark):
    rows = [(1, k % 5, k) for k in range(300)] + [(k, k % 3, k) for k in range(2, 900)] + [(5, 1, 7), (None, 1, 1), (6, None, 2), (1, None, 3)]
    df = spark.createDataFrame(rows, "g long, b long, o long")
    got = ordered.keyed_row_number(df, "g", F.col("b"), ["o"], "n")
    seen, want = {}, []
    for g, b, o in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        seen[g] = seen.get(g, 0) + 1
        want += [(g, b, o, seen[g])] if b is not None else []
    assert sorted((r.g, r.b, r.o, r.n) for r in got.collect()) == want
    plain = ordered.bucketed_row_number(df, ["g"], F.col("b"), ["o"], "n")
    assert sorted((r.g, r.b, r.o, r.n) for r in plain.collect()) == want


def test_unwrapping_takes_plain_ids_and_bonds_listed_twice(spark):
    atoms = spark.createDataFrame([(1, 9.5, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, 1.5, 9.5, 0.0), (4, 5.0, 5.0, 5.0)], "atom_id long, x double, y double, z double")
    bonds = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (2, 3)], "a1 long, a2 long")
    assert dict(graph._image_edges(atoms, bonds, [], 10.0).dtypes)["u"] == "bigint"
    out = graph.unwrap_molecules(atoms, bonds, [], 10.0)
    assert sorted((r.atom_id, r.molecule, r.x, r.y, r.z) for r in out.collect()) == [
        (1, 1, 9.5, 0.0, 0.0), (2, 1, 10.5, 0.0, 0.0), (3, 1, 11.5, -0.5, 0.0), (4, 4, 5.0, 5.0, 5.0)]
    framed = graph.unwrap_molecules(atoms.withColumn("frame", F.lit(7)), bonds.withColumn("frame", F.lit(7)), ["frame"], 10.0)
    assert sorted((r.atom_id, r.molecule, r.x) for r in framed.collect()) == [(1, 1, 9.5), (2, 1, 10.5), (3, 1, 11.5), (4, 4, 5.0)]
