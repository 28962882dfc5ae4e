"""Streaming jobs run over files derived from the driver tables; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.histograms import bin_index_by_kind
from ..session import scratch_path
from ..sources import dump
from ..streaming import monitor as S
from .coarse_queries import _MASSES
from .registry import query, r
from .statistic_queries import _RANGES, bonded_values

ALL_FILES = 2**31 - 1


def land_and_run(landings, order, source, out, label, job, sink=None):
    """Write each landing as many files in ranges of ``order`` and run the job over it before the next one lands.

    A landing is one micro-batch whatever its number of files, so a timestep is never split over two.
    """
    spark = landings[0].sparkSession
    state = scratch_path(spark, f"{label}-state")
    for landing in landings:
        landing.repartitionByRange(*order).write.mode("append").parquet(source)
        stream = S.table_stream(spark, source, landing.schema, ALL_FILES)
        with S.keyed_state(spark):
            S.run_available(job(stream), "append", sink or S.append_sink(out), label, state)


def _ingested(timestep: str):
    """Arrival times that follow from the data: a second for each timestep, from a day after the watermark's zero on."""
    return F.timestamp_seconds(F.col(timestep) + 86400).alias("ingested")


def _detector_input(t):
    """(run, timestep, bond_type, lo, hi, ingested) of four snapshots, with heartbeats, as two landings in order."""
    steps = t.bonds.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("timestep"), "bond_type", F.col("a1").alias("lo"), F.col("a2").alias("hi"))
    snaps = S.with_heartbeats(steps.where("(lo + timestep) % 7 <> 0").select("*", F.lit(0).cast("bigint").alias("run"), _ingested("timestep")))
    return [snaps.where(half) for half in ("timestep <= 2", "timestep > 2")]


@query("str1_reaction_totals", " UNION ALL ".join(f"SELECT traj, 'r{c}' AS reaction, sum(N{c})::BIGINT AS total, max(timestep) AS timestep FROM fx_counts GROUP BY 1" for c in ("11", "12", "21", "22")))
def _(t):
    source, out = scratch_path(t.spark, "counts"), scratch_path(t.spark, "totals")
    long = t.counts.select("traj", "timestep", F.inline(F.array(*[F.struct(F.lit(f"r{c}").alias("reaction"), F.col(f"N{c}").alias("n")) for c in ("11", "12", "21", "22")])))
    long.repartition(6, "timestep").write.parquet(source)
    totals = S.running_totals(S.table_stream(t.spark, source, long.schema, 3), ["traj", "reaction"], "n")
    S.run_available(totals, "update", S.append_sink(out), "totals")
    return S.latest(t.spark.read.parquet(out), ["traj", "reaction"], ["total", "timestep"])


@query("str2_reaction_detector", """
    WITH s AS (SELECT k AS timestep, bond_type, a1 AS lo, a2 AS hi FROM fx_bonds, range(1, 5) t(k) WHERE (a1 + k) % 7 <> 0)
    SELECT 0::BIGINT AS run, b.timestep, b.lo, b.hi, b.bond_type, 'created' AS status FROM s b ANTI JOIN s a ON a.timestep = b.timestep - 1 AND a.lo = b.lo AND a.hi = b.hi WHERE b.timestep > 1
    UNION ALL SELECT 0, a.timestep + 1, a.lo, a.hi, a.bond_type, 'deleted' FROM s a ANTI JOIN s b ON b.timestep = a.timestep + 1 AND a.lo = b.lo AND a.hi = b.hi WHERE a.timestep < 4""")
def _(t):
    source, out = scratch_path(t.spark, "snapshots"), scratch_path(t.spark, "changes")
    land_and_run(_detector_input(t), ["timestep", "lo"], source, out, "changes", S.bond_changes)
    return t.spark.read.parquet(out).drop("batch", "b")


@query("str2_frame_pairs", """
    WITH s AS (SELECT k AS timestep, a1 AS lo, a2 AS hi FROM fx_bonds, range(1, 5) t(k) WHERE (a1 + k) % 7 <> 0),
    c AS (SELECT DISTINCT b.timestep FROM s b ANTI JOIN s a ON a.timestep = b.timestep - 1 AND a.lo = b.lo AND a.hi = b.hi WHERE b.timestep > 1
          UNION SELECT a.timestep + 1 FROM s a ANTI JOIN s b ON b.timestep = a.timestep + 1 AND a.lo = b.lo AND a.hi = b.hi WHERE a.timestep < 4)
    SELECT 0::BIGINT AS run, c.timestep AS event, side, c.timestep - back AS timestep, atom_id, type, round(x + (c.timestep - back) * 0.125::DOUBLE, 6) AS x
    FROM c, (VALUES ('before', 1), ('after', 0)) v(side, back), fx_atoms""")
def _(t):
    """The snapshots before and at each timestep at which the detector saw a bond change."""
    source, frames, out = (scratch_path(t.spark, label) for label in ("snapshots", "landed-frames", "frame-pairs"))
    steps = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("timestep")
    atoms = t.atoms.select(F.lit(0).cast("bigint").alias("run"), steps, "atom_id", "type", "x")
    atoms.withColumn("x", F.col("x") + F.col("timestep") * F.lit(0.125)).repartitionByRange("timestep", "atom_id").write.parquet(frames)
    land_and_run(_detector_input(t), ["timestep", "lo"], source, out, "pairs", S.bond_changes, S.frame_pairs_sink(frames, 1, out))
    return t.spark.read.parquet(out).drop("b").withColumn("x", r("x"))


@query("str3_evolving_mapping", """
    SELECT bead_id, timestep, (t0 - 1 + rn - 1) % 6 + 1 AS old_type, (t0 - 1 + rn) % 6 + 1 AS new_type FROM (
      SELECT user_id AS bead_id, event_id AS timestep, user_id % 6 + 1 AS t0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)""")
def _(t):
    source, out = scratch_path(t.spark, "reactions"), scratch_path(t.spark, "types")
    rows = t.events.select(
        F.lit(0).cast("bigint").alias("run"), F.col("user_id").alias("bead_id"), (F.col("user_id") % 6 + 1).alias("initial_type"), F.col("event_id").alias("timestep"), _ingested("event_id"))
    half = rows.agg(F.max("timestep").alias("m")).scalar() / 2
    tagged = rows.withColumn("late", F.col("timestep") > half)
    types = {k: k % 6 + 1 for k in range(1, 7)}
    halves = [tagged.where(late).drop("late") for late in ("NOT late", "late")]
    land_and_run(halves, ["timestep"], source, out, "types", lambda stream: S.evolving_types(stream, types))
    return t.spark.read.parquet(out).drop("run", "batch", "b")


_OWN_BOX = {"x": 52.5, "y": 50.035, "z": 51.25}


@query("str4_bead_frames", f"""
    WITH k AS (SELECT *, {", ".join(f"coalesce(round_even(({a} - lag({a}) OVER (PARTITION BY mol_id ORDER BY pos)) / {e}::DOUBLE, 0), 0) AS k{a}" for a, e in _OWN_BOX.items())} FROM fx_atoms),
    u AS (SELECT atom_id, type, {", ".join(f"{a} - {e}::DOUBLE * sum(k{a}) OVER (PARTITION BY mol_id ORDER BY pos) AS {a}" for a, e in _OWN_BOX.items())} FROM k),
    c AS (SELECT m.bead_id, sum(coalesce(w.mass, 1)) AS mass, {", ".join(f"sum(coalesce(w.mass, 1) * {a}) / sum(coalesce(w.mass, 1)) AS {a}" for a in "xyz")}
      FROM u JOIN fx_map m USING (atom_id) LEFT JOIN ({_MASSES}) w ON w.type = u.type GROUP BY 1)
    SELECT 7000::BIGINT AS timestep, bead_id, round(mass, 6) AS mass, {", ".join(f"round({a} - floor({a} / {e}::DOUBLE) * {e}::DOUBLE, 8) AS {a}" for a, e in _OWN_BOX.items())} FROM c""")
def _(t):
    """Beads of a landed frame, made whole and wrapped in the box that its own header gives."""
    source, out = scratch_path(t.spark, "frames"), scratch_path(t.spark, "beads")
    atoms = t.atoms.select(F.lit(7000).cast("bigint").alias("timestep"), F.col("atom_id").alias("id"), "type", "x", "y", "z")
    dump.write_dump(atoms, source, tuple(_OWN_BOX.values()))
    masses = t.atoms.select("type").distinct().where("type < 6").withColumn("mass", F.lit(1.0) + F.col("type") * F.lit(0.5))
    S.run_available(dump.dump_stream(t.spark, source), "append", S.bead_frames_sink(t.bonds, t.mapping, masses, out), "beads")
    return t.spark.read.parquet(out).select("timestep", "bead_id", r("mass").alias("mass"), *[r(ax, 8).alias(ax) for ax in "xyz"])


@query("str5_incremental_distributions", """
    SELECT kind, type_id, CASE WHEN value BETWEEN lo AND hi THEN least(floor((value - lo) / w)::BIGINT, nb - 1) END AS i, count(*) AS n
    FROM fx_terms JOIN (VALUES ('bond', 0.0::DOUBLE, 40.0::DOUBLE, 1.0::DOUBLE, 40), ('angle', 0, 180, 5, 36), ('dihedral', -180, 180, 10, 36)) v(kind, lo, hi, w, nb) USING (kind)
    WHERE NOT (kind = 'bond' AND type_id = 2) GROUP BY ALL""")
def _(t):
    """Bonds, angles and torsions in the ranges of AG14; values outside their range are counted in the null bin."""
    source, out = scratch_path(t.spark, "terms"), scratch_path(t.spark, "bins")
    values = bonded_values(t).select("frame", "kind", "type_id", "value")
    values.repartition(3, "frame").write.parquet(source)
    finished = t.spark.createDataFrame([("bond", 2)], "kind string, type_id bigint")
    stream = S.table_stream(t.spark, source, values.schema, 1)
    hist = S.streaming_histogram(stream, ["kind", "type_id"], bin_index_by_kind("value", _RANGES), finished)
    S.run_available(hist, "update", S.append_sink(out), "bins")
    return S.latest(t.spark.read.parquet(out), ["kind", "type_id", "i"], ["n"])
