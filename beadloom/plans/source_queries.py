"""Sources and sinks: derived tables go out to the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bonds as B
from ..operators import expand
from ..session import scratch_path
from ..sources import curve_files as CF
from ..sources import dump, tables
from .fixtures import BOX
from .registry import query, r


def _bead_atoms(t):
    return t.beads.select(F.col("frame").alias("timestep"), (F.col("bead_id") + 1).alias("id"), "type", "x", "y", "z")


def _dumped(t, images=False):
    path = scratch_path(t.spark, "dump")
    atoms = _bead_atoms(t)
    if images:
        atoms = atoms.select("*", *[(F.col("id") % m - 1).alias(f"i{ax}") for ax, m in (("x", 3), ("y", 4), ("z", 5))])
    dump.write_dump(atoms, path, BOX, images=images)
    return path


@query("src1_dump_scan", """
    SELECT frame AS timestep, bead_id + 1 AS id, type, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, (bead_id + 1) % 3 - 1 AS ix,
           (bead_id + 1) % 4 - 1 AS iy, (bead_id + 1) % 5 - 1 AS iz, 50.035::DOUBLE AS lx FROM fx_beads""")
def _(t):
    out = dump.read_dump(t.spark, _dumped(t, images=True))
    return out.select("timestep", "id", "type", *[r(ax, 3).alias(ax) for ax in "xyz"], "ix", "iy", "iz", (F.col("box.xhi") - F.col("box.xlo")).alias("lx"))


@query("src2_strided_frames", "SELECT frame AS timestep, frame // 2 AS frame, count(*) AS n_atoms FROM fx_beads WHERE frame % 2 = 0 GROUP BY ALL")
def _(t):
    """Frames 0 and 2 of three; the file name is left out of the keys of the stride, as one run fills several files."""
    atoms = dump.read_dump(t.spark, _dumped(t))
    frames = dump.strided_frames(atoms.select("timestep").distinct().withColumn("run", F.lit(0)), ["run"], stride=2).select("timestep", "frame")
    return dump.checked_frames(atoms.join(frames, "timestep"), ["timestep", "frame"])


def _data_files(t):
    path = scratch_path(t.spark, "data")
    name = F.concat(F.lit("sys"), F.floor(F.col("mol_id") / 2000).cast("string")).alias("name")
    masses = t.atoms.select("type").distinct().withColumn("mass", F.col("type") * F.lit(2.5) - 2.5)
    atoms = t.atoms.select(name, "atom_id", "mol_id", "type", "x", "y", "z")
    bonds = t.bonds.select(name, "bond_type", "a1", "a2")
    tables.write_data_files(tables.data_file_lines(atoms, bonds, masses, BOX), path)
    return path


@query("src3_data_file_scan", """
    SELECT 'atom' AS kind, atom_id AS k1, mol_id AS k2, type AS k3, round(x, 3) AS v FROM fx_atoms
    UNION ALL SELECT 'bond', a1, a2, bond_type, NULL FROM fx_bonds
    UNION ALL SELECT 'box', NULL, NULL, NULL, 50.035::DOUBLE FROM (SELECT DISTINCT mol_id // 2000 FROM fx_atoms) CROSS JOIN range(3)""")
def _(t):
    parts = tables.read_data_file(t.spark, _data_files(t))
    none = F.lit(None).cast("bigint")
    atoms = parts["atoms"].select(F.lit("atom").alias("kind"), F.col("id").alias("k1"), F.col("mol_id").alias("k2"), F.col("type").alias("k3"), r("x", 3).alias("v"))
    bonds = parts["bonds"].select(F.lit("bond").alias("kind"), F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.col("bond_type").alias("k3"), F.lit(None).cast("double").alias("v"))
    box = parts["box"].select(F.lit("box").alias("kind"), none.alias("k1"), none.alias("k2"), none.alias("k3"), (F.col("hi") - F.col("lo")).alias("v"))
    return atoms.unionByName(bonds).unionByName(box)


@query("src4_mass_scan", """
    SELECT DISTINCT 'sys' || (mol_id // 2000)::VARCHAR AS system, type, type * 2.5::DOUBLE - 2.5::DOUBLE AS mass, 'T' || type::VARCHAR AS name FROM fx_atoms WHERE type > 1""")
def _(t):
    m = tables.read_masses(t.spark, _data_files(t))
    return m.select(F.regexp_extract("file", "name=([^/]+)/", 1).alias("system"), "type", "mass", "name")


@query("src5_mapping_scan", "SELECT bead_id, mol_id, bead_type, atom_id, mass FROM fx_map")
def _(t):
    path = scratch_path(t.spark, "mapping")
    out = t.mapping.withColumnRenamed("atom_id", "AA_id")
    tables.write_table_text(out, path, ["bead_id", "mol_id", "bead_type", "AA_id", "mass"], sep=",", header=True)
    return tables.read_mapping(t.spark, path)


@query("src6_reaction_details", """
    SELECT event_id, cycle, t1, t2, distance, reaction_type, least(t1, t2)::VARCHAR || '-' || greatest(t1, t2)::VARCHAR AS pair_type FROM fx_events""")
def _(t):
    path = scratch_path(t.spark, "details")
    rows = t.reactions.select("event_id", "cycle", F.col("t1").alias("atom1_type_before"), F.col("t2").alias("atom2_type_before"), "distance", "reaction_type")
    rows.write.csv(path, header=True)
    return tables.read_reaction_details(t.spark, path)


@query("src7_reaction_frames", "SELECT frame, bond_type, a1, a2 FROM fx_after")
def _(t):
    path = scratch_path(t.spark, "frames")
    tables.write_reaction_frames(t.before, t.after, path)
    return tables.read_reaction_frames(t.spark, path, "bonds_after")


@query("src8_reaction_counts", " UNION ALL ".join(f"SELECT traj, timestep, 'r{c}' AS reaction, N{c} AS n FROM fx_counts" for c in ("11", "12", "21", "22")))
def _(t):
    path = scratch_path(t.spark, "counts")
    names = t.counts.select("traj").distinct().select(F.format_string("run%d", "traj").alias("name"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("i"), F.lit("# timestep r11 r12 r21 r22").alias("line"))
    body = t.counts.select(F.format_string("run%d", "traj").alias("name"), F.lit(1).alias("part"), F.col("cycle").alias("i"), F.format_string("%d %d %d %d %d", "timestep", "N11", "N12", "N21", "N22").alias("line"))
    tables.write_data_files(names.unionByName(body), path)
    out = tables.read_reaction_counts(t.spark, path)
    return out.select(F.regexp_extract("file", r"name=run(\d+)/", 1).cast("bigint").alias("traj"), "timestep", "reaction", "n")


@query("src9_topology_scan", """
    SELECT 'bonds' AS kind, bond_type AS type, a1 AS b1, a2 AS b2, NULL::BIGINT AS b3 FROM fx_bonds
    UNION ALL SELECT 'angles', 1, a.atom_id, a.atom_id + 1, a.atom_id + 2 FROM fx_atoms a JOIN fx_atoms b ON b.atom_id = a.atom_id + 2""")
def _(t):
    p1, p2 = scratch_path(t.spark, "cg_bonds"), scratch_path(t.spark, "cg_angles")
    bonds = t.bonds.select(F.col("bond_type").alias("# type"), F.col("a1").alias("atom1_id"), F.col("a2").alias("atom2_id"))
    tables.write_table_text(bonds, p1, ["`# type`", "atom1_id", "atom2_id"], header=True)
    angles = B.angles_from_bonds(t.bonds).withColumn("type", F.lit(1))
    tables.write_table_text(angles, p2, ["type", "b1", "b2", "b3"], header=True)
    one = tables.read_topology(t.spark, p1, "bonds").withColumn("b3", F.lit(None).cast("bigint")).withColumn("kind", F.lit("bonds"))
    return one.unionByName(tables.read_topology(t.spark, p2, "angles").withColumn("kind", F.lit("angles")))


def _named_curves(t):
    m = F.col("curve_id") % 3
    kind = F.when(m == 0, "bond").when(m == 1, "angle").otherwise("rdf")
    return t.curves.withColumn("name", F.concat(kind, F.lit("_"), F.col("curve_id").cast("string"), F.lit(".dist.tgt")))


def _curve_files(t, finished=None):
    path = scratch_path(t.spark, "dist")
    CF.write_distributions(_named_curves(t), path, finished)
    return path


_KIND = "CASE curve_id % 3 WHEN 0 THEN 'bond' WHEN 1 THEN 'angle' ELSE 'pair' END"


@query("src10_distribution_scan", f"SELECT {_KIND} AS kind, curve_id::VARCHAR AS types, i, x, round(p, 9) AS p, 2.0::DOUBLE AS step FROM fx_curves")
def _(t):
    out = CF.read_distributions(t.spark, _curve_files(t))
    return out.select("kind", "types", "i", "x", r("p", 9).alias("p"), "step")


@query("src11_distribution_files", f"SELECT DISTINCT {_KIND} AS kind, curve_id::VARCHAR AS types FROM fx_curves")
def _(t):
    return CF.discover_distributions(t.spark, _curve_files(t)).select("kind", "types")


def _tables_named(t):
    m = F.col("table_id") % 3
    kind = F.when(m == 0, "bond").when(m == 1, "angle").otherwise("pair")
    return t.potentials.withColumn("kind", kind).withColumn("name", F.concat(kind, F.lit("_"), F.col("table_id").cast("string")))


@query("src12_potential_scan", """
    SELECT CASE table_id % 3 WHEN 0 THEN 'bond' WHEN 1 THEN 'angle' ELSE 'pair' END AS kind, table_id::VARCHAR AS types, 200::BIGINT AS n_header, 200::BIGINT AS n_rows, true AS count_ok,
           i, round(x, 6) AS x, round(u, 6) AS u FROM fx_potentials""")
def _(t):
    path = scratch_path(t.spark, "tables")
    CF.write_potentials(_tables_named(t), path)
    out = CF.read_potential_tables(t.spark, path)
    return out.select("kind", "types", "n_header", "n_rows", "count_ok", "i", r("x").alias("x"), r("u").alias("u"))


@query("src13_reference_distances", "SELECT floor(distance) AS distance, count(*) AS n FROM fx_events GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "reference")
    bins = t.reactions.groupBy(F.floor("distance").cast("double").alias("bin_center")).agg(F.count(F.lit(1)).alias("count"))
    bins.write.csv(path, header=True)
    return tables.read_reference_distances(t.spark, path).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


@query("src15_multi_run_frames", """
    SELECT bead_id % 2 AS traj, frame // 2 AS chunk, frame AS timestep, count(*) AS n, row_number() OVER (PARTITION BY bead_id % 2 ORDER BY frame // 2, frame) AS cycle FROM fx_beads GROUP BY 1, 2, 3""")
def _(t):
    from ..operators.ordered import bucketed_row_number

    base = scratch_path(t.spark, "runs")
    for chunk in (0, 1):
        for md in (0, 1):
            part = _bead_atoms(t).where(f"timestep div 2 = {chunk} AND (id - 1) % 2 = {md}")
            dump.write_dump(part, f"{base}/chunk{chunk}/md{md}", BOX)
    atoms = tables.with_run_path(dump.read_dump(t.spark, f"{base}/*/*"))
    frames = atoms.groupBy("traj", "chunk", "timestep").agg(F.count(F.lit(1)).alias("n"))
    return bucketed_row_number(frames, ["traj"], F.col("chunk"), ["timestep"], "cycle")


@query("snk1_dump_lines", """
    SELECT frame AS timestep, bead_id + 1 AS id, printf('%5d %5d %8.3f %8.3f %8.3f', bead_id + 1, type, x, y, z) AS line FROM fx_beads
    UNION ALL SELECT frame, 0, unnest(['ITEM: TIMESTEP', frame::VARCHAR, 'ITEM: NUMBER OF ATOMS', count(*)::VARCHAR, 'ITEM: BOX BOUNDS pp pp pp',
      concat_ws(chr(10), '0.00000000 50.03500000', '0.00000000 50.03500000', '0.00000000 50.03500000'), 'ITEM: ATOMS id type x y z']) FROM fx_beads GROUP BY frame""")
def _(t):
    return dump.dump_lines(_bead_atoms(t), BOX).select("timestep", "id", "line")


@query("snk2_xyz_rows", """
    SELECT line, count(*) AS n FROM (SELECT printf('T%d %.6f %.6f %.6f', type, x, y, z) AS line FROM fx_beads
      UNION ALL SELECT count(*)::VARCHAR FROM fx_beads GROUP BY frame UNION ALL SELECT DISTINCT 'frame ' || frame::VARCHAR FROM fx_beads) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "xyz")
    dump.write_rows(_bead_atoms(t), path, "timestep", "xyz")
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("snk3_distribution_export", f"SELECT {_KIND} AS kind, curve_id::VARCHAR AS types, count(*) AS n, round(sum(p), 6) AS total FROM fx_curves WHERE curve_id % 5 <> 0 GROUP BY ALL")
def _(t):
    done = _named_curves(t).where("curve_id % 5 = 0").select("name")
    out = CF.read_distributions(t.spark, _curve_files(t, done))
    return out.groupBy("kind", "types").agg(F.count(F.lit(1)).alias("n"), r(F.sum("p")).alias("total"))


@query("snk2_gro_rows", """
    SELECT line, count(*) AS n FROM (
      SELECT printf('%5d%-5s%5s%5d%8.3f%8.3f%8.3f', (bead_id // 10) % 100000, 'MOL', 'T' || type::VARCHAR, (bead_id + 1) % 100000, (x + 0.003::DOUBLE) / 10.0::DOUBLE, (y + 0.003::DOUBLE) / 10.0::DOUBLE, (z + 0.003::DOUBLE) / 10.0::DOUBLE) AS line FROM fx_beads
      UNION ALL SELECT printf('%5d', count(*)) FROM fx_beads GROUP BY frame UNION ALL SELECT DISTINCT 'frame ' || frame::VARCHAR FROM fx_beads
      UNION ALL SELECT '   5.00350   5.00350   5.00350' FROM (SELECT DISTINCT frame FROM fx_beads)) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "gro")
    # Moved off the ties of the third decimal, which the two engines round differently.
    atoms = _bead_atoms(t).withColumns({ax: F.col(ax) + F.lit(0.003) for ax in "xyz"})
    dump.write_rows(atoms.withColumn("mol_id", F.floor((F.col("id") - 1) / 10)), path, "timestep", "gro", BOX)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("snk4_potential_export", """
    WITH rows AS (SELECT *, CASE table_id % 3 WHEN 0 THEN 'bond' WHEN 1 THEN 'angle' ELSE 'pair' END || '_' || table_id::VARCHAR AS name, row_number() OVER w AS no,
        lag(x) OVER w AS x0, lead(x) OVER w AS x1, lag(u) OVER w AS u0, lead(u) OVER w AS u1 FROM fx_potentials WHERE i % 50 <> 7 WINDOW w AS (PARTITION BY table_id ORDER BY x))
    SELECT name, no::VARCHAR AS line, round(x, 6) AS x, round(u, 6) AS u, round(-CASE WHEN x0 IS NULL THEN (u1 - u) / (x1 - x) WHEN x1 IS NULL THEN (u - u0) / (x - x0)
        ELSE ((x - x0) * (x - x0) * u1 + ((x1 - x) * (x1 - x) - (x - x0) * (x - x0)) * u - (x1 - x) * (x1 - x) * u0) / ((x - x0) * (x1 - x) * (x1 - x0)) END, 6) AS f FROM rows
    UNION ALL SELECT name, line, NULL, NULL, NULL FROM (SELECT *, kind || '_' || table_id::VARCHAR AS name FROM (SELECT table_id, CASE table_id % 3 WHEN 0 THEN 'bond' WHEN 1 THEN 'angle' ELSE 'pair' END AS kind,
        count(*) AS n, min(x) AS lo, max(x) AS hi FROM fx_potentials WHERE i % 50 <> 7 GROUP BY 1, 2)),
      LATERAL (SELECT unnest(['# contributor: beadloom', kind || '_' || table_id::VARCHAR, CASE WHEN kind = 'pair' THEN printf('N %d R %.6f %.6f', n, lo, hi) ELSE printf('N %d', n) END, '']) AS line)""")
def _(t):
    holes = _tables_named(t).withColumn("u", F.when(F.col("i") % 50 != 7, F.col("u")))
    lines = CF.potential_lines(holes).withColumn("_w", F.when(F.col("part") == 9, F.split("line", " ")))
    return lines.select("name", F.coalesce(F.col("_w")[0], "line").alias("line"), *[r(F.col("_w")[k + 1]).alias(c) for k, c in enumerate("xuf")])


@query("snk5_topology_export", """
    SELECT DISTINCT 1::BIGINT AS type, least(m1.bead_id, m2.bead_id) AS b1, greatest(m1.bead_id, m2.bead_id) AS b2
    FROM fx_bonds b JOIN fx_map m1 ON m1.atom_id = a1 JOIN fx_map m2 ON m2.atom_id = a2 WHERE m1.bead_id <> m2.bead_id""")
def _(t):
    path = scratch_path(t.spark, "topology")
    tables.write_table_text(B.atom_bonds_to_bead_bonds(t.bonds, t.mapping, keys=()), path, ["bond_type", "b1", "b2"])
    return tables.read_topology(t.spark, path, "bonds")


@query("snk6_system_assembly", """
    WITH b AS (SELECT DISTINCT bead_id, bead_type FROM fx_map),
    bb AS (SELECT DISTINCT least(m1.bead_id, m2.bead_id) AS b1, greatest(m1.bead_id, m2.bead_id) AS b2 FROM fx_bonds b JOIN fx_map m1 ON m1.atom_id = a1 JOIN fx_map m2 ON m2.atom_id = a2 WHERE m1.bead_id <> m2.bead_id),
    n AS (SELECT mol_id, count(*) AS k FROM (SELECT DISTINCT mol_id, bead_id FROM fx_map) GROUP BY 1)
    SELECT 'beads' AS entity, (SELECT count(*) FROM b) AS n, (SELECT max(bead_type) FROM b) AS n_types
    UNION ALL SELECT 'bonds', (SELECT count(*) FROM bb), (SELECT count(DISTINCT least(x.bead_type, y.bead_type) * 10 + greatest(x.bead_type, y.bead_type)) FROM bb JOIN b x ON x.bead_id = b1 JOIN b y ON y.bead_id = b2)
    UNION ALL SELECT 'angles', (SELECT sum(greatest(k - 2, 0))::BIGINT FROM n), 6""")
def _(t):
    path = scratch_path(t.spark, "system")
    parts = expand.convert_to_beads(t.atoms, t.bonds, t.mapping, BOX)
    tables.write_system({k: parts[k] for k in ("beads", "bonds", "angles")}, path)
    stored = {k: t.spark.read.parquet(f"{path}/{k}") for k in ("beads", "bonds", "angles")}
    return tables.system_header(stored, {"beads": "bead_type", "bonds": "type_id", "angles": "type_id"})


@query("snk7_bond_archive", """
    SELECT frame % 2 AS run, count(*) AS n, min(frame * 1000) AS first_ts, max(frame * 1000) AS last_ts, count(DISTINCT bond_type) AS n_types FROM (
      SELECT frame, least(a1, a2) AS lo, greatest(a1, a2) AS hi, min(bond_type) AS bond_type FROM (SELECT *, 0 AS s FROM fx_before UNION ALL SELECT *, 1 FROM fx_after)
      GROUP BY 1, 2, 3 HAVING bool_or(s = 0) <> bool_or(s = 1)) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "archive")
    diff = B.bond_diff(t.before, t.after).select((F.col("frame") % 2).alias("run"), (F.col("frame") * 1000).alias("timestep"), "bond_type", "lo", "hi", "status")
    diff.write.partitionBy("run").mode("append").parquet(path)
    out = tables.archive_summary(t.spark.read.parquet(path), ["run"])
    return out.withColumn("run", F.col("run").cast("bigint"))
