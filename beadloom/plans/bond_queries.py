"""Bond diffs, bead bonds, derived topology, set operations, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import bonds as B
from ..operators import classify, events, spatial
from ..session import shuffled
from .fixtures import BOX, FRAME_BOX, FRAME_BOX_SQL
from .registry import query, r

_DIFF = """
    SELECT {keys}, bool_or(s = 0) AS b, bool_or(s = 1) AS a, min(bond_type) AS bond_type FROM (
      SELECT frame, bond_type, least(a1, a2) AS lo, greatest(a1, a2) AS hi, 0 AS s FROM fx_before UNION ALL
      SELECT frame, bond_type, least(a1, a2), greatest(a1, a2), 1 FROM fx_after) GROUP BY {keys}"""


@query("jn1_bond_diff", """
    SELECT a.frame, a.lo, a.hi, a.bond_type, 'created' AS status
    FROM (SELECT frame, least(a1, a2) lo, greatest(a1, a2) hi, min(bond_type) bond_type FROM fx_after GROUP BY ALL) a
    ANTI JOIN (SELECT frame, least(a1, a2) lo, greatest(a1, a2) hi FROM fx_before) b USING (frame, lo, hi)
    UNION ALL
    SELECT b.frame, b.lo, b.hi, b.bond_type, 'deleted'
    FROM (SELECT frame, least(a1, a2) lo, greatest(a1, a2) hi, min(bond_type) bond_type FROM fx_before GROUP BY ALL) b
    ANTI JOIN (SELECT frame, least(a1, a2) lo, greatest(a1, a2) hi FROM fx_after) a USING (frame, lo, hi)""")
def _(t):
    return B.bond_diff(t.before, t.after)


@query("jn2_typed_bond_diff", f"""
    SELECT frame, lo, hi, t AS bond_type, CASE WHEN a THEN 'created' ELSE 'deleted' END AS status
    FROM (SELECT frame, t, lo, hi, a, b FROM ({_DIFF.format(keys="frame, lo, hi, bond_type").replace("min(bond_type) AS bond_type", "min(bond_type) AS t")}))
    WHERE a <> b""")
def _(t):
    return B.bond_diff(t.before, t.after, typed=True)


@query("jn3_raw_bond_diff", """
    SELECT DISTINCT a.frame, least(a.a1, a.a2) AS lo, greatest(a.a1, a.a2) AS hi
    FROM fx_after a ANTI JOIN fx_before b USING (frame, a1, a2)""")
def _(t):
    return B.raw_new_bonds(t.before, t.after)


@query("jn4_changed_atoms", f"""
    SELECT DISTINCT frame, unnest([lo, hi]) AS atom_id FROM ({_DIFF.format(keys="frame, lo, hi")}) WHERE a <> b""")
def _(t):
    return B.changed_atoms(B.bond_diff(t.before, t.after))


@query("jn5_bead_bonds", """
    SELECT DISTINCT frame, least(m1.bead_id, m2.bead_id) AS b1, greatest(m1.bead_id, m2.bead_id) AS b2, 1::BIGINT AS bond_type
    FROM fx_before b JOIN fx_map m1 ON m1.atom_id = a1 JOIN fx_map m2 ON m2.atom_id = a2 WHERE m1.bead_id <> m2.bead_id""")
def _(t):
    return B.atom_bonds_to_bead_bonds(t.before, t.mapping)


@query("jn6_unmapped_atoms", """
    SELECT atom_id, (SELECT count(*) FROM m) AS n_unmapped FROM m ORDER BY atom_id LIMIT 10""".replace(
    "SELECT atom_id, (", """WITH m AS (SELECT DISTINCT atom_id FROM (SELECT unnest([a1, a2]) AS atom_id FROM fx_bonds)
      WHERE atom_id NOT IN (SELECT atom_id FROM fx_map WHERE atom_id % 97 <> 0)) SELECT atom_id, (""", 1))
def _(t):
    return B.unmapped_atoms(t.bonds, t.mapping.where("atom_id % 97 <> 0"))


@query("jn7_molecule_consistency", """
    WITH bm AS (SELECT DISTINCT bead_id, CASE WHEN bead_id % 13 = 0 THEN mol_id + 1 ELSE mol_id END AS mol FROM fx_map),
    bb AS (SELECT DISTINCT least(m1.bead_id, m2.bead_id) AS b1, greatest(m1.bead_id, m2.bead_id) AS b2
           FROM fx_bonds b JOIN fx_map m1 ON m1.atom_id = a1 JOIN fx_map m2 ON m2.atom_id = a2 WHERE m1.bead_id <> m2.bead_id)
    SELECT b1, b2, x.mol AS mol1, y.mol AS mol2 FROM bb JOIN bm x ON x.bead_id = b1 JOIN bm y ON y.bead_id = b2 WHERE CASE WHEN x.mol <> y.mol THEN 1 ELSE 0 END = 1""")
def _(t):
    beads = t.mapping.withColumn("mol_id", F.when(F.col("bead_id") % 13 == 0, F.col("mol_id") + 1).otherwise(F.col("mol_id")))
    return B.cross_molecule_bonds(B.atom_bonds_to_bead_bonds(t.bonds, t.mapping, keys=()), beads).select("b1", "b2", "mol1", "mol2")


_NAMED_SQL = """(SELECT least(ta, tb) AS lo, greatest(ta, tb) AS hi, arg_min(name, ord) AS name
      FROM (SELECT n_name AS name, n_nationkey AS ord, n_nationkey % 6 + 1 AS ta, n_nationkey * 2 % 6 + 1 AS tb FROM nation
            UNION ALL SELECT n_name, n_nationkey, n_nationkey % 6 + 1, n_nationkey * 5 % 6 + 1 FROM nation
            UNION ALL SELECT n_name, n_nationkey, n_nationkey * 2 % 6 + 1, n_nationkey * 5 % 6 + 1 FROM nation)
      WHERE ta <> tb GROUP BY 1, 2)"""


def framed_atoms(t):
    """Atoms at the three snapshot frames, drifting along x."""
    return t.atoms.select(
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("frame"), "atom_id", "type", "pos", "x", "y", "z"
    ).select("frame", "atom_id", "type", (F.col("x") + F.col("frame") * (F.col("pos") % 2) * F.lit(0.25)).alias("x"), "y", "z")


def mapping_after(t):
    return t.mapping.withColumn("bead_type", F.when(F.col("bead_id") % 2 == 0, F.col("bead_type") % 6 + 1).otherwise(F.col("bead_type")))


@query("jn8_rebuild_events", f"""
    WITH fa AS (SELECT frame, atom_id, type, x + frame * (pos % 2) * 0.25::DOUBLE AS x, y, z FROM fx_atoms, range(1, 4) t(frame)),
    c AS (SELECT frame, lo, hi FROM ({_DIFF.format(keys="frame, lo, hi")}) WHERE a AND NOT b),
    j AS (SELECT c.frame AS cycle, lo AS a1, hi AS a2, p.type AS t1, q.type AS t2, m1.bead_type AS bead_before_1, m2.bead_type AS bead_before_2,
            CASE WHEN m1.bead_id % 2 = 0 THEN m1.bead_type % 6 + 1 ELSE m1.bead_type END AS bead_after_1,
            CASE WHEN m2.bead_id % 2 = 0 THEN m2.bead_type % 6 + 1 ELSE m2.bead_type END AS bead_after_2,
            q.x - p.x - 50.035::DOUBLE * round_even((q.x - p.x) / 50.035::DOUBLE, 0) AS dx,
            q.y - p.y - 50.035::DOUBLE * round_even((q.y - p.y) / 50.035::DOUBLE, 0) AS dy,
            q.z - p.z - 50.035::DOUBLE * round_even((q.z - p.z) / 50.035::DOUBLE, 0) AS dz
          FROM c JOIN fa p ON p.frame = c.frame AND p.atom_id = lo JOIN fa q ON q.frame = c.frame AND q.atom_id = hi
          JOIN fx_map m1 ON m1.atom_id = lo JOIN fx_map m2 ON m2.atom_id = hi)
    SELECT cycle, a1, a2, t1, t2, bead_before_1, bead_before_2, bead_after_1, bead_after_2,
           round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS distance, coalesce(n.name, 'unknown') AS reaction_type,
           least(bead_before_1, bead_before_2)::VARCHAR || '-' || greatest(bead_before_1, bead_before_2)::VARCHAR AS pair_type
    FROM j LEFT JOIN {_NAMED_SQL} n ON n.lo = least(bead_before_1, bead_before_2) AND n.hi = greatest(bead_before_1, bead_before_2)""")
def _(t):
    from .kernel_queries import _named_reactions

    pairs = classify.reaction_pairs(_named_reactions(t))
    return events.rebuild_events(t.before, t.after, framed_atoms(t), t.mapping, mapping_after(t), pairs, BOX)


# Every molecule is a chain whose first atom also holds every other one: whole tables, and degrees that a molecule bounds.
@query("jn9_angles", """
    WITH b AS (SELECT a1, a2 FROM fx_bonds UNION SELECT atom_id - pos + 1, atom_id FROM fx_atoms WHERE pos >= 2),
    s AS (SELECT a1 AS n, a2 AS o FROM b UNION SELECT a2, a1 FROM b)
    SELECT p.o AS b1, p.n AS b2, q.o AS b3 FROM s p JOIN s q ON p.n = q.n AND p.o < q.o""")
def _(t):
    rings = t.atoms.where("pos >= 2").select((F.col("atom_id") - F.col("pos") + 1).alias("a1"), F.col("atom_id").alias("a2"))
    return B.angles_from_bonds(t.bonds.select("a1", "a2").unionByName(rings))


@query("jn10_dihedrals", """
    WITH s AS (SELECT a1 AS n, a2 AS o FROM fx_bonds UNION SELECT a2, a1 FROM fx_bonds)
    SELECT DISTINCT CASE WHEN l.o < q.o THEN l.o ELSE q.o END AS b1, CASE WHEN l.o < q.o THEN m.n ELSE m.o END AS b2,
           CASE WHEN l.o < q.o THEN m.o ELSE m.n END AS b3, CASE WHEN l.o < q.o THEN q.o ELSE l.o END AS b4
    FROM s m JOIN s l ON l.n = m.n AND l.o <> m.o JOIN s q ON q.n = m.o AND q.o <> m.n WHERE m.n < m.o AND l.o <> q.o""")
def _(t):
    return B.dihedrals_from_bonds(t.bonds)


def _pair_sql(cond, extra=""):
    edge = {ax: v.format(f="a.frame") for ax, v in FRAME_BOX_SQL.items()}
    d = " + ".join(
        f"pow(b.{ax} - a.{ax} - {edge[ax]} * round_even((b.{ax} - a.{ax}) / {edge[ax]}, 0), 2)" for ax in "xyz"
    )
    return f"SELECT a.frame, a.type AS ta, b.type AS tb, a.bead_id AS ia, b.bead_id AS ib, {d} AS d2 {extra} FROM fx_beads a JOIN fx_beads b ON a.frame = b.frame AND {cond}"


@query("jn11_candidate_pairs", f"""
    SELECT frame, count(*) FILTER (WHERE ta = 3 AND tb = 5 AND d2 < 25) AS E35, count(*) FILTER (WHERE ta = 3 AND tb = 6 AND d2 < 25) AS E36,
           count(*) FILTER (WHERE ta = 4 AND tb = 5 AND d2 < 25) AS E45, count(*) FILTER (WHERE ta = 4 AND tb = 6 AND d2 < 25) AS E46
    FROM ({_pair_sql("a.type IN (3, 4) AND b.type IN (5, 6)")}) GROUP BY 1""")
def _(t):
    return spatial.candidate_pairs(t.boxed_beads, ["frame"], FRAME_BOX, 5.0, K.END_TYPES, K.MONOMER_TYPES)


_HIST_SQL = f"""
    SELECT frame, least(ta, tb) AS t1, greatest(ta, tb) AS t2, least(floor(sqrt(d2) / 0.25::DOUBLE)::BIGINT, 23) AS i, count(*) AS n
    FROM ({_pair_sql("a.bead_id < b.bead_id")}) WHERE sqrt(d2) <= 6 GROUP BY ALL"""


@query("jn12_pair_histogram", _HIST_SQL)
def _(t):
    return spatial.pair_histogram(t.boxed_beads, ["frame"], FRAME_BOX, 6.0, 24)


# Beads k and k+1, k+2, k+3 of every block of ten count as bonded.
def bead_chain(t, step):
    ids = shuffled(t.part.where(f"p_partkey % 10 < {10 - step}"))
    return ids.select(F.col("p_partkey").alias("a1"), (F.col("p_partkey") + step).alias("a2")).join(
        t.part.select(F.col("p_partkey").alias("a2")), "a2", "left_semi"
    ).select("a1", "a2")


def bead_exclusions(t):
    angles = bead_chain(t, 2).select(F.col("a1").alias("b1"), F.col("a2").alias("b3"))
    dihedrals = bead_chain(t, 3).select(F.col("a1").alias("b1"), F.col("a2").alias("b4"))
    return B.exclusion_pairs(bead_chain(t, 1), angles, dihedrals)


_EXCL_SQL = """(SELECT a.p_partkey AS lo, b.p_partkey AS hi FROM part a JOIN part b
      ON b.p_partkey - a.p_partkey BETWEEN 1 AND 3 AND a.p_partkey // 10 = b.p_partkey // 10)"""


@query("jn13_bonded_exclusions", f"""
    SELECT frame, ia AS lo, ib AS hi, round(d2, 6) AS d2 FROM ({_pair_sql("a.bead_id < b.bead_id")}) p
    WHERE d2 < 9 AND NOT EXISTS (SELECT 1 FROM {_EXCL_SQL} e WHERE e.lo = p.ia AND e.hi = p.ib)""")
def _(t):
    once = F.col("l_bead_id") < F.col("r_bead_id")
    beads = B.with_excluded(t.boxed_beads, bead_exclusions(t), "bead_id")
    pairs = spatial.neighbour_join(beads, t.boxed_beads, ["frame"], FRAME_BOX, 3.0, condition=once, half=True)
    near = B.drop_excluded(pairs.where("l_bead_id <> r_bead_id"), "l_excluded", "r_bead_id")
    return near.select(F.least("l_bead_id", "r_bead_id").alias("lo"), F.greatest("l_bead_id", "r_bead_id").alias("hi"), "frame", r("d2").alias("d2"))


@query("jn14_reacted_neighbourhood", f"""
    SELECT DISTINCT frame, atom_id FROM (
      SELECT frame, bead_id AS atom_id FROM fx_beads WHERE bead_id % 40 = frame
      UNION ALL SELECT frame, ib FROM ({_pair_sql("a.bead_id % 40 = a.frame")}) WHERE d2 < 36)""")
def _(t):
    points = t.boxed_beads.withColumnRenamed("bead_id", "atom_id").drop("type")
    return spatial.reacted_neighbourhood(points, points.where("atom_id % 40 = frame"), ["frame"], FRAME_BOX, 6.0)


@query("jn19_pre_event_frames", """
    SELECT event_id, e.traj, e.cycle * 1000 AS timestep, f.n5 AS n5, f.timestep AS frame_ts
    FROM fx_events e JOIN fx_counts f ON f.traj = e.traj AND f.timestep = e.cycle * 1000 - 1000 WHERE e.cycle > 1""")
def _(t):
    ev = t.reactions.where("cycle > 1").select("event_id", "traj", (F.col("cycle") * 1000).alias("timestep"))
    frames = t.counts.select("traj", "timestep", "n5")
    return events.pre_event_frames(ev, frames, 1000, ["traj"]).select("event_id", "traj", "timestep", "n5", "frame_ts")


@query("jn20_frame_as_of", """
    SELECT event_id, e.traj, e.cycle * 1000 + event_id % 1000 AS timestep, f.timestep AS frame_timestep
    FROM fx_events e ASOF LEFT JOIN (SELECT traj, timestep FROM fx_counts WHERE cycle % 7 = 0) f
      ON e.traj = f.traj AND e.cycle * 1000 + event_id % 1000 >= f.timestep""")
def _(t):
    targets = t.reactions.select("event_id", "traj", (F.col("cycle") * 1000 + F.col("event_id") % 1000).alias("timestep"))
    frames = t.counts.where("cycle % 7 = 0").select("traj", "timestep")
    return events.frame_as_of(targets, frames, ["traj"])


@query("jn21_events_on_grid", """
    SELECT traj, cycle, sum(coalesce(N11 + N12, 0))::BIGINT AS n3x, sum(coalesce(N21 + N22, 0))::BIGINT AS n4x FROM fx_counts GROUP BY 1, 2""")
def _(t):
    ch = K.channel("t1", "t2")
    per = t.reactions.groupBy("traj", "cycle").agg(
        F.count_if(ch.isin("11", "12")).alias("n3x"), F.count_if(ch.isin("21", "22")).alias("n4x")
    )
    return events.events_on_grid(t.cycle_grid, per, ["traj", "cycle"], ["n3x", "n4x"])


@query("jn22_reaction_details", f"""
    WITH c AS (SELECT frame, lo, hi FROM ({_DIFF.format(keys="frame, lo, hi")}) WHERE a AND NOT b),
    bp AS (SELECT bead_id, arg_min(x, a.atom_id) AS x, arg_min(y, a.atom_id) AS y, arg_min(z, a.atom_id) AS z
           FROM fx_atoms a JOIN fx_map m USING (atom_id) GROUP BY 1 HAVING bead_id % 5 <> 0)
    SELECT frame, lo, hi, m1.bead_id AS bead_1, m2.bead_id AS bead_2, m1.bead_type AS before_1, m2.bead_type AS before_2,
           CASE WHEN m1.bead_id % 2 = 0 THEN m1.bead_type % 6 + 1 ELSE m1.bead_type END AS after_1,
           CASE WHEN m2.bead_id % 2 = 0 THEN m2.bead_type % 6 + 1 ELSE m2.bead_type END AS after_2,
           round(coalesce(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)), -1), 6) AS distance
    FROM c JOIN fx_map m1 ON m1.atom_id = lo JOIN fx_map m2 ON m2.atom_id = hi
    LEFT JOIN bp p ON p.bead_id = m1.bead_id LEFT JOIN bp q ON q.bead_id = m2.bead_id""")
def _(t):
    from ..operators.coarse import bead_positions
    from ..operators.matching import reaction_details

    positions = bead_positions(t.atoms, t.mapping).where("bead_id % 5 <> 0")
    diff = B.bond_diff(t.before, t.after)
    return reaction_details(diff, t.mapping, mapping_after(t), positions).withColumn("distance", r("distance"))


@query("so1_union_exclusions", f"SELECT DISTINCT lo, hi FROM {_EXCL_SQL}")
def _(t):
    return bead_exclusions(t)


@query("so2_bond_set_update", """
    SELECT frame, bond_type, a1, a2 FROM (SELECT * FROM fx_before EXCEPT SELECT * FROM fx_before WHERE a1 % 4 = 0)
    UNION SELECT * FROM fx_after WHERE a2 % 3 = 0""")
def _(t):
    return B.update_bond_set(t.before, t.before.where("a1 % 4 = 0"), t.after.where("a2 % 3 = 0"))


@query("so3_set_difference", """
    SELECT frame, count(*) FILTER (WHERE a AND NOT b) AS created, count(*) FILTER (WHERE b AND NOT a) AS deleted
    FROM (""" + _DIFF.format(keys="frame, lo, hi") + ") GROUP BY 1")
def _(t):
    diff = B.bond_diff(t.before, t.after)
    return diff.groupBy("frame").agg(
        F.count_if(F.col("status") == "created").alias("created"), F.count_if(F.col("status") == "deleted").alias("deleted")
    )


@query("so4_union_runs", """
    SELECT run, frame, count(*) AS n, min(a1) AS lo, max(a2) AS hi FROM (
      SELECT 'first' AS run, * FROM fx_before UNION ALL SELECT 'second', * FROM fx_after) GROUP BY 1, 2""")
def _(t):
    from ..sources.tables import union_runs

    runs = union_runs({"first": t.before, "second": t.after})
    return runs.groupBy("run", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("a1").alias("lo"), F.max("a2").alias("hi"))


@query("so5_dedup", """
    SELECT DISTINCT m1.bead_id, m1.mol_id FROM fx_map m1""")
def _(t):
    return t.mapping.dropDuplicates(["bead_id", "mol_id"]).select("bead_id", "mol_id")


@query("gr2_adjacency", """
    SELECT n.atom_id AS node, count(s.o) AS degree, coalesce(array_to_string(list_sort(list(s.o) FILTER (WHERE s.o IS NOT NULL)), ','), '') AS neighbours
    FROM fx_atoms n LEFT JOIN (SELECT a1 AS n, a2 AS o FROM fx_bonds UNION SELECT a2, a1 FROM fx_bonds) s ON s.n = n.atom_id GROUP BY 1""")
def _(t):
    from ..operators.graph import neighbour_lists

    lists = neighbour_lists(t.bonds, t.atoms.select(F.col("atom_id").alias("node")))
    return lists.select("node", "degree", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))
