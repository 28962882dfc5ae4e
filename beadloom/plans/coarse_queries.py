"""Coarse-graining, components, unwrapping, fingerprints and table generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bonds as B
from ..operators import coarse, expand, fingerprint, graph
from ..session import cut_lineage
from .fixtures import BOX, ID_SPAN
from .registry import query, r

_MASSES = "SELECT type, 1 + type * 0.5::DOUBLE AS mass FROM (SELECT DISTINCT l_partkey % 6 + 1 AS type FROM lineitem) WHERE type < 6"


@query("ag1_centre_of_mass", f"""
    SELECT m.bead_id, round(sum(coalesce(w.mass, 1)), 6) AS mass,
           round(sum(coalesce(w.mass, 1) * x) / sum(coalesce(w.mass, 1)), 6) AS x,
           round(sum(coalesce(w.mass, 1) * y) / sum(coalesce(w.mass, 1)), 6) AS y,
           round(sum(coalesce(w.mass, 1) * z) / sum(coalesce(w.mass, 1)), 6) AS z
    FROM fx_atoms a JOIN fx_map m USING (atom_id) LEFT JOIN ({_MASSES}) w ON w.type = a.type GROUP BY 1""")
def _(t):
    masses = t.lineitem.select((F.col("l_partkey") % 6 + 1).alias("type")).distinct().where("type < 6").select(
        "type", (F.lit(1.0) + F.col("type") * F.lit(0.5)).alias("mass")
    )
    com = coarse.centre_of_mass(t.atoms, t.mapping, masses)
    return com.select("bead_id", r("mass").alias("mass"), *[r(ax).alias(ax) for ax in "xyz"])


_MI = "({a} - 50.035::DOUBLE * round_even(({a}) / 50.035::DOUBLE, 0))"


@query("ag2_periodic_centre_of_mass", f"""
    SELECT bead_id, mass, n AS n_atoms, {", ".join(f"round(r{a} + w{a} / mass, 9) AS {a}" for a in "xyz")}
    FROM (SELECT bead_id, sum(mass) AS mass, count(*) AS n, {", ".join(f"min(r{a}) AS r{a}, sum(mass * d{a}) AS w{a}" for a in "xyz")}
      FROM (SELECT bead_id, mass, {", ".join(f"r{a}, {_MI.format(a=f'(j.{a} - r{a})')} AS d{a}" for a in "xyz")}
        FROM (SELECT a.*, m.bead_id, {", ".join(f"first_value({a}) OVER (PARTITION BY m.bead_id ORDER BY a.atom_id) AS r{a}" for a in "xyz")}
              FROM fx_atoms a JOIN fx_map m USING (atom_id)) j) GROUP BY 1)""")
def _(t):
    com = coarse.periodic_centre_of_mass(t.atoms, t.mapping, BOX)
    return com.select("bead_id", "mass", "n_atoms", *[r(ax, 9).alias(ax) for ax in "xyz"])


@query("ag3_bead_info", """
    SELECT bead_id, arg_min(mol_id, atom_id) AS mol_id, arg_min(bead_type, atom_id) AS bead_type, sum(mass) AS mass FROM fx_map GROUP BY 1""")
def _(t):
    return coarse.bead_info(t.mapping)


@query("ag4_mapping_consistency", """
    SELECT bead_id, count(DISTINCT bt) AS n_types, min(bt) AS lo_type, max(bt) AS hi_type
    FROM (SELECT bead_id, CASE WHEN atom_id % 50 = 0 THEN bead_type % 6 + 1 ELSE bead_type END AS bt FROM fx_map) GROUP BY 1 HAVING count(DISTINCT bt) > 1""")
def _(t):
    noisy = t.mapping.withColumn("bead_type", F.when(F.col("atom_id") % 50 == 0, F.col("bead_type") % 6 + 1).otherwise(F.col("bead_type")))
    return coarse.mixed_type_beads(noisy)


@query("ag11_molecule_sizes", "SELECT mol_id, count(*) AS n_atoms FROM fx_atoms GROUP BY 1")
def _(t):
    return coarse.molecule_sizes(t.atoms)


_BB = """bb AS (SELECT DISTINCT least(m1.bead_id, m2.bead_id) AS b1, greatest(m1.bead_id, m2.bead_id) AS b2
      FROM fx_bonds b JOIN fx_map m1 ON m1.atom_id = a1 JOIN fx_map m2 ON m2.atom_id = a2 WHERE m1.bead_id <> m2.bead_id),
    bt AS (SELECT DISTINCT bead_id, mol_id, bead_type AS t FROM fx_map)"""


@query("ag15_ordered_bond_types", f"""
    WITH {_BB}, j AS (SELECT b1, b2, x.t AS t1, y.t AS t2 FROM bb JOIN bt x ON x.bead_id = b1 JOIN bt y ON y.bead_id = b2),
    f AS (SELECT t1, t2, row_number() OVER (ORDER BY min((b1, b2))) AS type_id FROM j GROUP BY 1, 2)
    SELECT j.*, type_id FROM j JOIN f USING (t1, t2)""")
def _(t):
    bb = B.atom_bonds_to_bead_bonds(t.bonds, t.mapping, keys=()).select("b1", "b2")
    types = coarse.bead_info(t.mapping).select("bead_id", "bead_type")
    return B.ordered_type_ids(bb, types, ("b1", "b2"))


@query("ag16_topology_type_ids", f"""
    WITH {_BB}, j AS (SELECT b1, b2, least(x.t, y.t)::VARCHAR || '-' || greatest(x.t, y.t)::VARCHAR AS combo
      FROM bb JOIN bt x ON x.bead_id = b1 JOIN bt y ON y.bead_id = b2),
    pre AS (SELECT '1-2' AS combo, 7::BIGINT AS id UNION ALL SELECT '3-4', 9),
    f AS (SELECT combo, 9 + row_number() OVER (ORDER BY min((b1, b2))) AS id FROM j WHERE combo NOT IN (SELECT combo FROM pre) GROUP BY 1)
    SELECT b1, b2, combo, id AS type_id FROM j JOIN (SELECT * FROM pre UNION ALL SELECT * FROM f) USING (combo)""")
def _(t):
    bb = B.atom_bonds_to_bead_bonds(t.bonds, t.mapping, keys=()).select("b1", "b2")
    types = coarse.bead_info(t.mapping).select("bead_id", "bead_type")
    presets = t.spark.createDataFrame([("1-2", 7), ("3-4", 9)], "combo string, type_id bigint")
    return B.type_ids(bb, ["b1", "b2"], types, "bond", presets)


@query("gr1_connected_components", """
    WITH RECURSIVE s AS (SELECT u AS n, v AS o FROM fx_edges UNION SELECT v, u FROM fx_edges),
    r(n, l) AS (SELECT n, n FROM s UNION SELECT s.o, r.l FROM r JOIN s ON s.n = r.n WHERE r.l < s.o),
    lab AS (SELECT p.p_partkey AS node, coalesce(m.l, p.p_partkey) AS label FROM part p LEFT JOIN (SELECT n, min(l) AS l FROM r GROUP BY 1) m ON m.n = p.p_partkey
            UNION ALL SELECT n, min(l) FROM r WHERE n >= 1000000000 GROUP BY 1)
    SELECT node, label, dense_rank() OVER (ORDER BY label) AS component FROM lab""")
def _(t):
    pairs = t.edges.select(F.col("u").alias("a1"), F.col("v").alias("a2"))
    nodes = t.part.select(F.col("p_partkey").alias("node")).unionByName(t.edges.select(F.col("v").alias("node")))
    return graph.connected_components(pairs, nodes)


@query("gr3_molecule_unwrap", f"""
    SELECT atom_id, min(atom_id) OVER (PARTITION BY mol_id) AS molecule, {", ".join(
        f"round({a} + 50.035::DOUBLE * coalesce(sum(-k{a}) OVER (PARTITION BY mol_id ORDER BY pos), 0), 6) AS {a}" for a in "xyz")}
    FROM (SELECT *, {", ".join(f"coalesce(round_even(({a} - lag({a}) OVER (PARTITION BY mol_id ORDER BY pos)) / 50.035::DOUBLE, 0), 0) AS k{a}" for a in "xyz")}
          FROM fx_atoms)""")
def _(t):
    out = graph.unwrap_molecules(t.atoms, t.bonds, [], BOX)
    return out.select("atom_id", "molecule", *[r(ax).alias(ax) for ax in "xyz"])


@query("gr3_closed_molecules", f"""
    WITH n AS (SELECT *, {", ".join(f"lead({a}) OVER w AS n{a}, first_value({a}) OVER w AS f{a}" for a in "xyz")}, row_number() OVER w AS i, min(atom_id) OVER (PARTITION BY mol_id) AS molecule,
        count(*) OVER (PARTITION BY mol_id) AS n FROM fx_atoms WINDOW w AS (PARTITION BY mol_id ORDER BY pos)),
    k AS (SELECT molecule, {", ".join(f"abs(sum(round_even((CASE WHEN i = n THEN f{a} ELSE n{a} END - {a}) / 50.035::DOUBLE, 0)))::BIGINT AS w{a}" for a in "xyz")}
      FROM n WHERE n > 2 GROUP BY molecule)
    SELECT * FROM k WHERE wx > 0 OR wy > 0 OR wz > 0""")
def _(t):
    """Molecules bent into rings: which of them go around the box, and how often."""
    ends = t.atoms.groupBy("mol_id").agg(F.max("atom_id").alias("a1"), F.min("atom_id").alias("a2"), F.count(F.lit(1)).alias("n")).where("n > 2")
    return graph.closed_molecules(t.atoms, t.bonds.select("a1", "a2").unionByName(ends.select("a1", "a2")), [], BOX)


@query("gr4_unwrap_by_molecule", f"""
    SELECT atom_id, {", ".join(f"round(CASE WHEN n = 1 THEN {a} ELSE m{a} + {_MI.format(a=f'({a} - m{a})')} END, 6) AS {a}" for a in "xyz")}
    FROM (SELECT *, {", ".join(f"avg(u{a}) OVER (PARTITION BY mol_id) AS m{a}" for a in "xyz")}
      FROM (SELECT *, {", ".join(f"f{a} + {_MI.format(a=f'({a} - f{a})')} AS u{a}" for a in "xyz")}
        FROM (SELECT *, count(*) OVER (PARTITION BY mol_id) AS n, {", ".join(f"first_value({a}) OVER (PARTITION BY mol_id ORDER BY atom_id) AS f{a}" for a in "xyz")} FROM fx_atoms)))""")
def _(t):
    return graph.unwrap_by_molecule(t.atoms, [], BOX).select("atom_id", *[r(ax).alias(ax) for ax in "xyz"])


@query("gr5_neighbourhood", """
    WITH s AS (SELECT u AS n, v AS o FROM fx_edges UNION SELECT v, u FROM fx_edges),
    l1 AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 200 = 0),
    l2 AS (SELECT DISTINCT o AS n FROM s JOIN l1 USING (n)), l3 AS (SELECT DISTINCT o AS n FROM s JOIN l2 USING (n))
    SELECT n AS node, min(level) AS level FROM (SELECT n, 1::BIGINT AS level FROM l1 UNION ALL SELECT n, 2 FROM l2 UNION ALL SELECT n, 3 FROM l3) GROUP BY 1""")
def _(t):
    pairs = t.edges.select(F.col("u").alias("a1"), F.col("v").alias("a2"))
    return graph.neighbourhood(pairs, t.part.where("p_partkey % 200 = 0").select(F.col("p_partkey").alias("node")), 3)


@query("gr6_reaction_clusters", """
    WITH RECURSIVE d AS (SELECT frame, least(a1, a2) AS lo, greatest(a1, a2) AS hi, bool_or(s = 0) AS b, bool_or(s = 1) AS a
      FROM (SELECT *, 0 AS s FROM fx_before UNION ALL SELECT *, 1 FROM fx_after) GROUP BY 1, 2, 3 HAVING bool_or(s = 0) <> bool_or(s = 1)),
    c AS (SELECT frame, lo AS n, hi AS o FROM d WHERE a UNION SELECT frame, hi, lo FROM d WHERE a),
    r(frame, n, l) AS (SELECT frame, n, n FROM c UNION SELECT c.frame, c.o, r.l FROM r JOIN c ON c.frame = r.frame AND c.n = r.n WHERE r.l < c.o),
    m AS (SELECT frame, n, min(l) AS l FROM r GROUP BY 1, 2),
    orph AS (SELECT DISTINCT frame, n FROM (SELECT frame, unnest([lo, hi]) AS n FROM d) ANTI JOIN m USING (frame, n)),
    g AS (SELECT frame, a1 AS n, a2 AS o FROM fx_before UNION SELECT frame, a2, a1 FROM fx_before),
    ad AS (SELECT o.frame, o.n, min(m.l) AS l FROM orph o JOIN g ON g.frame = o.frame AND g.n = o.n JOIN m ON m.frame = g.frame AND m.n = g.o GROUP BY 1, 2)
    SELECT frame, n AS atom_id, l AS cluster FROM m UNION ALL
    SELECT o.frame, o.n, coalesce(ad.l, o.n) FROM orph o LEFT JOIN ad ON ad.frame = o.frame AND ad.n = o.n""")
def _(t):
    diff = B.bond_diff(t.before, t.after)
    return graph.cluster_reactions(diff.where("status = 'created'"), B.changed_atoms(diff), t.before)


@query("gr8_chain_tracing", f"""
    WITH {_BB}, ends AS (SELECT DISTINCT mol_id, bead_id FROM fx_map WHERE bead_id % 16777216 = 5),
    starts AS (SELECT DISTINCT mol_id, bead_id FROM fx_map WHERE bead_id % 16777216 = 1)
    SELECT s.mol_id AS template, s.bead_id AS start, b.bead_id - s.bead_id AS position, b.bead_id
    FROM starts s JOIN bt b ON b.mol_id = s.mol_id AND b.bead_id > s.bead_id AND b.bead_id < s.bead_id + 4""")
def _(t):
    bb = B.atom_bonds_to_bead_bonds(t.bonds, t.mapping, keys=())
    template = F.floor(F.col("b1") / ID_SPAN)
    bonds = bb.select(template.alias("template"), F.col("b1").alias("a1"), F.col("b2").alias("a2"))
    beads = t.mapping.select(F.col("mol_id").alias("template"), "bead_id").distinct()
    return graph.trace_chains(beads.where(f"bead_id % {ID_SPAN} = 1"), bonds, beads.where(f"bead_id % {ID_SPAN} = 5"))


def _bead_fingerprints(t):
    beads = cut_lineage(coarse.bead_info(t.mapping)).select(
        F.col("bead_id").alias("id"), "mol_id", (F.col("bead_id") % ID_SPAN).alias("local"), F.col("bead_type").alias("type")
    )
    bb = cut_lineage(B.atom_bonds_to_bead_bonds(t.bonds, t.mapping, keys=()))
    as_bonds = bb.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"))
    terms = [(bb, ["b1", "b2"]), (B.angles_from_bonds(as_bonds), ["b1", "b2", "b3"]), (B.dihedrals_from_bonds(as_bonds), ["b1", "b2", "b3", "b4"])]
    return fingerprint.molecule_fingerprints(beads, terms)


_CLASS_SQL = """cls AS (SELECT mol_id, min(mol_id) OVER (PARTITION BY fp) AS first_mol FROM (
      SELECT mol_id, string_agg(bead_type::VARCHAR, ',' ORDER BY bead_id) AS fp FROM (SELECT DISTINCT mol_id, bead_id, bead_type FROM fx_map) GROUP BY 1)),
    num AS (SELECT mol_id, first_mol, dense_rank() OVER (ORDER BY first_mol) AS class_id FROM cls)"""


@query("ag32_molecule_fingerprint", f"WITH {_CLASS_SQL} SELECT mol_id, first_mol, class_id FROM num")
def _(t):
    return fingerprint.structure_classes(_bead_fingerprints(t)).select("mol_id", "first_mol", "class_id")


@query("win12_equal_runs", f"""
    WITH {_CLASS_SQL}, f AS (SELECT *, CASE WHEN class_id = lag(class_id) OVER (ORDER BY mol_id) THEN 0 ELSE 1 END AS new FROM num),
    i AS (SELECT *, sum(new) OVER (ORDER BY mol_id)::BIGINT AS run FROM f)
    SELECT run, max(class_id) AS class_id, count(*) AS n_molecules, min(mol_id) AS first_mol, max(mol_id) AS last_mol FROM i GROUP BY 1""")
def _(t):
    return fingerprint.equal_runs(fingerprint.structure_classes(_bead_fingerprints(t)))


def _specs(t):
    s = F.col("s_suppkey")
    site = "struct<start:bigint,bead_type:bigint,indices:array<bigint>,weights:array<double>>"

    def sites(*rows):
        return F.array(*[
            F.struct(F.lit(a).cast("bigint"), b, F.array(*[F.lit(v).cast("bigint") for v in idx]), F.array(*[F.lit(w) for w in ws]))
            for a, b, idx, ws in rows
        ]).cast(f"array<{site}>")

    big = lambda v: F.lit(v).cast("bigint")
    first = t.supplier.select(
        s.alias("spec"), big(0).alias("config"), (s % 3 + 1).alias("copies"), (s % 2).alias("anchor"), (s % 2 + 1).alias("repeat"),
        big(5).alias("offset"), sites((0, s % 6 + 1, [0, 1], [1.0, 2.0]), (2, (s + 1) % 6 + 1, [0, 1, 2], [1.0, 1.0, 3.0])).alias("sites"),
    )
    second = t.supplier.select(
        s.alias("spec"), big(1).alias("config"), (s % 3 + 1).alias("copies"), big(12).alias("anchor"), big(1).alias("repeat"),
        big(4).alias("offset"), sites((0, s % 4 + 1, [0, 2, 3], [5.0, 1.0, 1.0])).alias("sites"),
    )
    return first.unionByName(second)


@query("exp1_mapping_generation", """
    WITH sp AS (SELECT s_suppkey AS s, s_suppkey % 3 + 1 AS copies, s_suppkey % 2 + 1 AS rep0 FROM supplier),
    o AS (SELECT *, sum(copies * (rep0 * 2 + 1)) OVER w - copies * (rep0 * 2 + 1) AS ob, sum(copies * (rep0 + 1)) OVER w - copies * (rep0 + 1) AS om,
                 sum(copies * 16) OVER w - copies * 16 AS oa FROM sp WINDOW w AS (ORDER BY s)),
    c AS (SELECT *, copy - 1 AS cp FROM o, range(1, 10) t(copy) WHERE copy <= copies),
    x AS (SELECT ob + cp * (rep0 * 2 + 1) + (rep - 1) * 2 + site + 1 AS bead_id, om + cp * (rep0 + 1) + rep AS mol_id,
                 CASE WHEN site = 0 THEN s % 6 + 1 ELSE (s + 1) % 6 + 1 END AS bead_type,
                 oa + cp * 16 + s % 2 + (rep - 1) * 5 + site * 2 AS base,
                 CASE WHEN site = 0 THEN [0, 1] ELSE [0, 1, 2] END AS idx, CASE WHEN site = 0 THEN [1, 2] ELSE [1, 1, 3] END AS w
          FROM c, range(1, 3) r(rep), range(2) q(site) WHERE rep <= rep0
          UNION ALL SELECT ob + cp * (rep0 * 2 + 1) + rep0 * 2 + 1, om + cp * (rep0 + 1) + rep0 + 1, s % 4 + 1, oa + cp * 16 + 12, [0, 2, 3], [5, 1, 1] FROM c)
    SELECT bead_id::BIGINT AS bead_id, mol_id::BIGINT AS mol_id, bead_type, (base + i + 1)::BIGINT AS aa_id, m::DOUBLE AS mass FROM (SELECT *, unnest(idx) AS i, unnest(w) AS m FROM x)""")
def _(t):
    return expand.generate_mapping(_specs(t))


def _templates(t):
    s = F.col("s_suppkey")
    mols = t.supplier.select(s.alias("spec"), (s % 4 + 1).alias("copies"))
    atoms = t.supplier.select(s.alias("spec"), F.explode(F.sequence(F.lit(1).cast("bigint"), s % 4 + 2)).alias("atom_id")).withColumn(
        "type", (F.col("spec") + F.col("atom_id")) % 6 + 1
    )
    bonds = atoms.where("atom_id > 1").select("spec", (F.col("atom_id") - 1).alias("a1"), F.col("atom_id").alias("a2"))
    return mols, atoms, bonds


_SYSTEM_SQL = """
    WITH sp AS (SELECT s_suppkey AS s, s_suppkey % 4 + 1 AS copies, s_suppkey % 4 + 2 AS n FROM supplier),
    o AS (SELECT *, sum(copies * n) OVER (ORDER BY s) - copies * n AS base FROM sp),
    c AS (SELECT s, n, base + (copy - 1) * n AS b FROM o, range(1, 10) t(copy) WHERE copy <= copies),
    k AS (SELECT * FROM c, range(1, 7) q(j) WHERE j <= n)
    SELECT kind, m1::BIGINT AS m1, m2::BIGINT AS m2, m3::BIGINT AS m3, m4::BIGINT AS m4 FROM (
      SELECT 'atom' AS kind, b + j AS m1, (s + j) % 6 + 1 AS m2, NULL AS m3, NULL AS m4 FROM k
      UNION ALL SELECT 'bond', b + j - 1, b + j, NULL, NULL FROM k WHERE j > 1
      UNION ALL SELECT 'angle', b + j - 2, b + j - 1, b + j, NULL FROM k WHERE j > 2
      UNION ALL SELECT 'dihedral', b + j - 3, b + j - 2, b + j - 1, b + j FROM k WHERE j > 3)"""


def _union_system(parts):
    cols = {"atoms": ["atom_id", "type"], "bonds": ["a1", "a2"], "angles": ["b1", "b2", "b3"], "dihedrals": ["b1", "b2", "b3", "b4"]}
    out = None
    for name, ids in cols.items():
        padded = [F.col(c) for c in ids] + [F.lit(None).cast("bigint")] * (4 - len(ids))
        part = parts[name].select(F.lit(name[:-1]).alias("kind"), *[c.alias(f"m{k + 1}") for k, c in enumerate(padded)])
        out = part if out is None else out.unionByName(part)
    return out


@query("exp2_system_replication", _SYSTEM_SQL)
def _(t):
    return _union_system(expand.replicate_system(*_templates(t)))


@query("exp3_molecule_expansion", _SYSTEM_SQL)
def _(t):
    mols, atoms, bonds = _templates(t)
    angles = atoms.where("atom_id > 2").select("spec", (F.col("atom_id") - 2).alias("b1"), (F.col("atom_id") - 1).alias("b2"), F.col("atom_id").alias("b3"))
    dihedrals = atoms.where("atom_id > 3").select("spec", *[(F.col("atom_id") - 4 + k).alias(f"b{k}") for k in range(1, 5)])
    counted = t.supplier.agg(F.sum((F.col("s_suppkey") % 4 + 1) * (F.col("s_suppkey") % 4 + 2)).alias("n")).scalar()
    return _union_system(expand.replicate_system(mols, atoms, bonds, angles, dihedrals, expected_atoms=counted))


@query("exp4_system_conversion", f"""
    WITH {_BB}, g AS (SELECT b1 AS n, b2 AS o FROM bb UNION SELECT b2, b1 FROM bb),
    ang AS (SELECT p.o AS b1, p.n AS b2, q.o AS b3 FROM g p JOIN g q ON p.n = q.n AND p.o < q.o),
    dih AS (SELECT DISTINCT CASE WHEN l.o < q.o THEN l.o ELSE q.o END AS b1, CASE WHEN l.o < q.o THEN m.n ELSE m.o END AS b2,
           CASE WHEN l.o < q.o THEN m.o ELSE m.n END AS b3, CASE WHEN l.o < q.o THEN q.o ELSE l.o END AS b4
      FROM g m JOIN g l ON l.n = m.n AND l.o <> m.o JOIN g q ON q.n = m.o AND q.o <> m.n WHERE m.n < m.o AND l.o <> q.o),
    tb AS (SELECT 'bonds' AS kind, [b1, b2] AS m, list_sort([x.t, y.t]) AS c FROM bb JOIN bt x ON x.bead_id = b1 JOIN bt y ON y.bead_id = b2),
    ta AS (SELECT 'angles' AS kind, [b1, b2, b3] AS m, least([x.t, y.t, z.t], [z.t, y.t, x.t]) AS c
      FROM ang JOIN bt x ON x.bead_id = b1 JOIN bt y ON y.bead_id = b2 JOIN bt z ON z.bead_id = b3),
    td AS (SELECT 'dihedrals' AS kind, [b1, b2, b3, b4] AS m, least([x.t, y.t, z.t, w.t], [w.t, z.t, y.t, x.t]) AS c
      FROM dih JOIN bt x ON x.bead_id = b1 JOIN bt y ON y.bead_id = b2 JOIN bt z ON z.bead_id = b3 JOIN bt w ON w.bead_id = b4),
    al AS (SELECT * FROM tb UNION ALL SELECT * FROM ta UNION ALL SELECT * FROM td),
    ids AS (SELECT kind, c, row_number() OVER (PARTITION BY kind ORDER BY min(m)) AS type_id FROM al GROUP BY 1, 2)
    SELECT kind, array_to_string(m, '-') AS members, array_to_string(c, '-') AS combo, type_id FROM al JOIN ids USING (kind, c)
    UNION ALL SELECT 'beads', bead_id::VARCHAR, t::VARCHAR, mol_id FROM bt""")
def _(t):
    parts = expand.convert_to_beads(t.atoms, t.bonds, t.mapping, BOX)
    out = parts["beads"].select(
        F.lit("beads").alias("kind"), F.col("bead_id").cast("string").alias("members"), F.col("bead_type").cast("string").alias("combo"),
        F.col("mol_id").alias("type_id"),
    )
    for kind, n in (("bonds", 2), ("angles", 3), ("dihedrals", 4)):
        members = F.concat_ws("-", *[F.col(f"b{k}").cast("string") for k in range(1, n + 1)])
        out = out.unionByName(parts[kind].select(F.lit(kind).alias("kind"), members.alias("members"), "combo", "type_id"))
    return out
