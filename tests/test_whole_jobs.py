"""Jobs that a fixed SQL statement cuts short, over the whole of their input."""

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def against_sql(spark, name):
    import __spark_entry__ as entry
    from oracle_check import compare, duck

    return compare(entry.queries()[name](spark, SF_DIR), duck(SF_DIR), entry.oracle_sql()[name])


@needs_tables
def test_reactivity_covers_every_cycle(spark):
    from beadloom.plans.catalogue import QUERIES
    from beadloom.plans.fixtures import Inputs

    assert against_sql(spark, "st12_reactivity_analysis") == []
    frames = Inputs(spark, SF_DIR).cycle_grid.count()
    report = {(x.part, x.item, x.name): x.v for x in QUERIES["st12c_reactivity_report"](spark, SF_DIR).collect()}
    assert frames > 100 and report["diagnostic", "all", "n_cycles"] == frames
    assert {k[0] for k in report} == {"estimate", "bootstrap", "window", "fit", "diagnostic"}
    assert report["bootstrap", "r1_bulk", "lo"] <= report["estimate", "all", "r1_bulk"] <= report["bootstrap", "r1_bulk", "hi"]
    total = sum(report["diagnostic", "all", f"N{c}"] for c in ("11", "12", "21", "22"))
    assert all(sum(v for k, v in report.items() if k[0] == "window" and k[1].endswith(f"/{w}") and k[2] == "n_events") == total for w in (10, 20, 40))


@needs_tables
def test_incremental_distributions_cover_every_kind(spark):
    from beadloom.plans.catalogue import QUERIES
    from beadloom.plans.fixtures import Inputs
    from beadloom.plans.statistic_queries import bonded_values

    assert against_sql(spark, "str5_incremental_distributions") == []
    rows = QUERIES["str5_incremental_distributions"](spark, SF_DIR).collect()
    assert {x.kind for x in rows} == {"bond", "angle", "dihedral"}
    kept = bonded_values(Inputs(spark, SF_DIR)).where("NOT (kind = 'bond' AND type_id = 2)").count()
    assert sum(x.n for x in rows) == kept


@needs_tables
def test_templates_by_name_and_loose_atoms(spark):
    assert against_sql(spark, "gr7_template_match") == []


def test_template_in_two_parts(spark):
    from beadloom.operators.matching import match_templates, typed_edges
    from beadloom.plans.matching_queries import TEMPLATE_SCHEMA

    # 1-2 are joined; 2-3-4-5 is a chain before; 6 is bonded to 7, away from them.
    kept = [(2, 3), (3, 4), (4, 5), (6, 7)]
    before = spark.createDataFrame([(1, *b) for b in kept], "frame bigint, a1 bigint, a2 bigint")
    after = spark.createDataFrame([(1, *b) for b in [(1, 2), *kept]], "frame bigint, a1 bigint, a2 bigint")
    types = spark.createDataFrame([(1, n, t) for n, t in enumerate((1, 2, 3, 4, 5, 4, 5), 1)], "frame bigint, atom_id bigint, type bigint")
    atoms = types.selectExpr("frame", "atom_id", "type AS t0", "type AS t1")
    bond, parts = [(1, 2, False, True)], [(1, 2, False, True), (3, 4, True, True)]
    ends = [(1, 1, 1), (2, 2, 2)]
    templates = spark.createDataFrame([
        ("parts", parts, [*ends, (3, 4, 4), (4, 5, 5)]), ("bond", bond, ends), ("alone", bond, [*ends, (5, 4, 4)]), ("far", bond, [*ends, (9, 5, 5)]),
    ], TEMPLATE_SCHEMA)
    got = match_templates(typed_edges(before, after, types, types), templates, atoms).collect()
    assert {(x.name, *x.atoms) for x in got} == {("parts", 1, 2, 4, 5), ("bond", 1, 2), ("alone", 1, 2, 4)}


@needs_tables
def test_distributions_include_rdf(spark):
    from beadloom.plans.catalogue import QUERIES

    assert against_sql(spark, "ag14_all_distributions") == []
    kinds = QUERIES["ag14_all_distributions"](spark, SF_DIR).select("kind").distinct().collect()
    assert {x.kind for x in kinds} == {"bond", "angle", "dihedral", "rdf"}


@needs_tables
@pytest.mark.parametrize("name", ["str2_reaction_detector", "str3_evolving_mapping", "src7"])
def test_many_files_give_the_same_rows(spark, name):
    import __spark_entry__ as entry

    assert against_sql(spark, next(n for n in entry.queries() if n.split("_")[0] == name.split("_")[0])) == []


def test_landings_are_many_files(spark, tmp_path):
    from beadloom.plans.stream_queries import land_and_run

    rows = spark.range(2000).selectExpr("id AS timestep", "id % 7 AS n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        land_and_run([rows.where("timestep < 900"), rows.where("timestep >= 900")], ["timestep"], f"{tmp_path}/in", f"{tmp_path}/out", "many", lambda s: s)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 2
    out = spark.read.parquet(f"{tmp_path}/out")
    got = out.groupBy("batch").agg({"timestep": "min", "*": "count"}).orderBy("batch").collect()
    assert [(x["min(timestep)"], x["count(1)"]) for x in got] == [(0, 900), (900, 1100)]


def test_frame_blocks_follow_the_frame_size(spark, tmp_path, monkeypatch):
    from beadloom.sources import tables

    monkeypatch.setattr(tables, "BLOCK_ROWS", 4)
    bonds = spark.range(5000).selectExpr("1L AS frame", "1L AS bond_type", "id AS a1", "id + 1 AS a2")
    tables.write_reaction_frames(bonds, bonds, str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).count() > 256
    assert tables.read_reaction_frames(spark, str(tmp_path / "frames"), "bonds_after").count() == 5000
