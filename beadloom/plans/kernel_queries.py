"""Projections and scalar kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import units as U
from ..functions.theory import theory_curves
from ..operators import classify
from ..operators.histograms import histogram
from .fixtures import BOX
from .registry import query, r


@query("prj1_min_image", """
    SELECT frame, bead_id,
           round((x - y) - 50.035::DOUBLE * round_even((x - y) / 50.035::DOUBLE, 0), 6) AS dx,
           round((y - z) - 50.035::DOUBLE * round_even((y - z) / 50.035::DOUBLE, 0), 6) AS dy,
           round((z - x) - 50.035::DOUBLE * round_even((z - x) / 50.035::DOUBLE, 0), 6) AS dz
    FROM fx_beads""")
def _(t):
    d = {"dx": F.col("x") - F.col("y"), "dy": F.col("y") - F.col("z"), "dz": F.col("z") - F.col("x")}
    return t.beads.select("frame", "bead_id", *[r(K.min_image(v, BOX)).alias(k) for k, v in d.items()])


@query("prj2_wrap", """
    SELECT frame, bead_id, floor((x * 3 - 40) / 50.035::DOUBLE)::BIGINT AS ix, floor((y * 2 + 7) / 50.035::DOUBLE)::BIGINT AS iy,
           round((x * 3 - 40) - floor((x * 3 - 40) / 50.035::DOUBLE) * 50.035::DOUBLE, 6) AS wx,
           round((y * 2 + 7) - floor((y * 2 + 7) / 50.035::DOUBLE) * 50.035::DOUBLE, 6) AS wy
    FROM fx_beads""")
def _(t):
    x, y = F.col("x") * 3 - 40, F.col("y") * 2 + 7
    return t.beads.select(
        "frame", "bead_id",
        K.image_index(x, 0.0, BOX).alias("ix"), K.image_index(y, 0.0, BOX).alias("iy"),
        r(K.wrapped(x, 0.0, BOX)).alias("wx"), r(K.wrapped(y, 0.0, BOX)).alias("wy"),
    )


@query("prj3_unwrap_images", """
    SELECT frame, bead_id, round(x + (bead_id % 5 - 2) * 50.035::DOUBLE, 6) AS ux,
           round(y + (bead_id % 3 - 1) * 50.035::DOUBLE, 6) AS uy, round(z + (frame - 1) * 50.035::DOUBLE, 6) AS uz
    FROM fx_beads""")
def _(t):
    return t.beads.select(
        "frame", "bead_id",
        r(K.unwrapped("x", F.col("bead_id") % 5 - 2, BOX)).alias("ux"),
        r(K.unwrapped("y", F.col("bead_id") % 3 - 1, BOX)).alias("uy"),
        r(K.unwrapped("z", F.col("frame") - 1, BOX)).alias("uz"),
    )


@query("prj4_image_decode", """
    SELECT p_partkey, (packed & 1023) - 512 AS ix, ((packed >> 10) & 1023) - 512 AS iy, (packed >> 20) - 512 AS iz
    FROM (SELECT p_partkey, (p_partkey * 7919 + 12345) * 1000003 % 1073741824 AS packed FROM part)""")
def _(t):
    packed = t.part.select("p_partkey", ((F.col("p_partkey") * 7919 + 12345) * 1000003 % 1073741824).alias("packed"))
    return packed.select("p_partkey", *[K.decode_image("packed", k).alias(f"i{ax}") for k, ax in enumerate("xyz")])


@query("prj5_bond_code", """
    SELECT code, code // 1000000001 AS lo, code % 1000000001 AS hi, count(*) AS n
    FROM (SELECT least(l_partkey + 900000000, 999999999 - l_suppkey) * 1000000001 + greatest(l_partkey + 900000000, 999999999 - l_suppkey) AS code FROM lineitem)
    GROUP BY 1""")
def _(t):
    n_ids = 1000000000  # codes beyond 2**53
    lo, hi = K.decode_bond("code", n_ids)
    coded = t.lineitem.select(K.bond_code(F.col("l_partkey") + 900000000, F.lit(999999999) - F.col("l_suppkey"), n_ids).alias("code"))
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", lo.alias("lo"), hi.alias("hi"), "n")


@query("prj6_channel", "SELECT event_id, ch AS channel FROM fx_channels")
def _(t):
    return t.reactions.select("event_id", K.channel("t1", "t2").alias("channel"))


def _named_reactions(t):
    k = F.col("n_nationkey").cast("bigint")
    return t.nation.select(
        F.col("n_name").alias("name"), k.alias("ord"),
        F.array(k % 6 + 1, k * 2 % 6 + 1, k * 5 % 6 + 1).alias("types"),
    )


@query("prj7_reaction_name", """
    SELECT e.event_id, coalesce(p.name, 'unknown') AS reaction FROM fx_events e LEFT JOIN (
      SELECT least(ta, tb) AS lo, greatest(ta, tb) AS hi, arg_min(name, ord) AS name
      FROM (SELECT n_name AS name, n_nationkey AS ord, n_nationkey % 6 + 1 AS ta, n_nationkey * 2 % 6 + 1 AS tb FROM nation
            UNION ALL SELECT n_name, n_nationkey, n_nationkey % 6 + 1, n_nationkey * 5 % 6 + 1 FROM nation
            UNION ALL SELECT n_name, n_nationkey, n_nationkey * 2 % 6 + 1, n_nationkey * 5 % 6 + 1 FROM nation)
      WHERE ta <> tb GROUP BY 1, 2) p ON p.lo = least(e.t1, e.t2) AND p.hi = greatest(e.t1, e.t2)""")
def _(t):
    pairs = classify.reaction_pairs(_named_reactions(t))
    return classify.with_reaction_name(t.reactions, pairs).select("event_id", "reaction")


@query("prj8_type_combos", """
    SELECT kind, combo, count(*) AS n FROM (
      SELECT 'bond' AS kind, least(a, b)::VARCHAR || '-' || greatest(a, b)::VARCHAR AS combo FROM q
      UNION ALL SELECT 'angle', least([a, b, c], [c, b, a])[1]::VARCHAR || '-' || b::VARCHAR || '-' || greatest(a, c)::VARCHAR FROM q
      UNION ALL SELECT 'dihedral', array_to_string(CASE WHEN [a, b, c, d] <= [d, c, b, a] THEN [a, b, c, d] ELSE [d, c, b, a] END, '-') FROM q
    ) GROUP BY 1, 2""".replace("FROM q", """FROM (SELECT l_partkey % 6 + 1 AS a, l_suppkey % 6 + 1 AS b,
      l_orderkey % 6 + 1 AS c, l_linenumber % 6 + 1 AS d FROM lineitem)"""))
def _(t):
    typed = t.lineitem.select(*[
        (F.col(c) % 6 + 1).cast("bigint").alias(n)
        for c, n in (("l_partkey", "a"), ("l_suppkey", "b"), ("l_orderkey", "c"), ("l_linenumber", "d"))
    ])
    combos = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.array_join(K.canonical_combo(kind, cols).cast("array<string>"), "-").alias("combo"))
        for kind, cols in (("bond", ["a", "b"]), ("angle", ["a", "b", "c"]), ("dihedral", ["a", "b", "c", "d"]))
    ])
    return typed.select(F.inline(combos)).groupBy("kind", "combo").agg(F.count(F.lit(1)).alias("n"))


@query("prj9_unit_conversion", """
    SELECT event_id, round(value / (CASE user_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 4.184 WHEN 2 THEN 0.0433641 ELSE 503.221 END)::DOUBLE
             * 4.184::DOUBLE, 6) AS kj,
           round(value / (CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 ELSE 100.0 END)::DOUBLE * 0.1::DOUBLE, 6) AS nm
    FROM events""")
def _(t):
    u, v = F.col("user_id") % 4, F.col("user_id") % 3
    unit = F.when(u == 0, "kcal/mol").when(u == 1, "kJ/mol").when(u == 2, "eV").otherwise("K")
    length = F.when(v == 0, "A").when(v == 1, "nm").otherwise("pm")
    return t.events.select(
        "event_id",
        r(U.convert_energy("value", unit, F.lit("kJ/mol"))).alias("kj"),
        r(U.convert_length("value", length, F.lit("nm"))).alias("nm"),
    )


@query("prj10_thermal_energy", """
    SELECT event_id, round((CASE user_id % 3 WHEN 0 THEN 0.0019872041 WHEN 1 THEN 0.0083144626 ELSE 8.617333262e-5 END)::DOUBLE
             * (300 + value), 12) AS kt FROM events""")
def _(t):
    u = F.col("user_id") % 3
    unit = F.when(u == 0, "kcal/mol").when(u == 1, "kJ/mol").otherwise("eV")
    return t.events.select("event_id", r(U.thermal_energy(F.col("value") + 300, unit), 12).alias("kt"))


@query("prj11_distribution_units", """
    SELECT curve_id, i, kind, round(x * s, 9) AS x, round(CASE WHEN kind = 'rdf' THEN p ELSE p / s END, 9) AS p
    FROM (SELECT *, CASE curve_id % 3 WHEN 0 THEN 'bond' WHEN 1 THEN 'rdf' ELSE 'angle' END AS kind,
                 CASE WHEN curve_id % 3 < 2 THEN 1.0::DOUBLE / 10.0::DOUBLE ELSE 1.0::DOUBLE / 57.29577951308232::DOUBLE END AS s
          FROM fx_curves)""")
def _(t):
    m = F.col("curve_id") % 3
    kinds = t.curves.withColumn("kind", F.when(m == 0, "bond").when(m == 1, "rdf").otherwise("angle"))
    source = F.when(m < 2, "A").otherwise("deg")
    target = F.when(m < 2, "nm").otherwise("rad")
    x, p = U.convert_distribution("kind", "x", "p", source, target)
    return kinds.select("curve_id", "i", "kind", x, p).withColumn("x", r("x", 9)).withColumn("p", r("p", 9))


@query("prj12_forcefield_units", """
    SELECT p_partkey, round(s, 9) AS sigma_nm, round(e, 9) AS epsilon_kj, round(4 * e * s6, 9) AS c6, round(4 * e * s6 * s6, 9) AS c12,
           round(p_size * 2 * 4.184::DOUBLE * 100, 6) AS k_bond, round(coalesce(own, m.mass), 6) AS mass
    FROM (SELECT *, s * s * s * s * s * s AS s6 FROM (
      SELECT p_partkey, p_size, (3 + p_size / 100.0::DOUBLE) * 0.1::DOUBLE AS s, p_retailprice / 5000.0::DOUBLE * 4.184::DOUBLE AS e,
             CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END AS own, p_partkey % 6 + 1 AS type FROM part))
    LEFT JOIN (SELECT bead_type AS type, arg_min(mass, bead_id) AS mass FROM (
      SELECT bead_id, min(bead_type) AS bead_type, sum(mass) AS mass FROM fx_map GROUP BY 1) GROUP BY 1) m USING (type)""")
def _(t):
    from ..operators.coarse import bead_info, mass_by_type

    sigma = F.lit(3.0) + F.col("p_size") / F.lit(100.0)
    lj = U.lj_to_c6_c12(sigma, F.col("p_retailprice") / 5000.0)
    params = t.part.withColumn("type", F.col("p_partkey") % 6 + 1)
    masses = mass_by_type(bead_info(t.mapping))
    own = F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice"))
    return params.join(masses.select(F.col("bead_type").alias("type"), "mass"), "type", "left").select(
        "p_partkey", r(lj["sigma"], 9).alias("sigma_nm"), r(lj["epsilon"], 9).alias("epsilon_kj"),
        r(lj["c6"], 9).alias("c6"), r(lj["c12"], 9).alias("c12"),
        r(F.col("p_size") * 2 * F.lit(4.184) * 100).alias("k_bond"), r(F.coalesce(own, "mass")).alias("mass"),
    )


@query("prj13_lj_inversion", """
    SELECT p_partkey, round(CASE WHEN c6 <= 0 OR c12 <= 0 THEN 0 ELSE pow(c12 / c6, 1.0::DOUBLE / 6) END, 6) AS sigma,
           round(CASE WHEN c6 <= 0 OR c12 <= 0 THEN 0 ELSE c6 * c6 / (4 * c12) END, 6) AS epsilon
    FROM (SELECT p_partkey, (p_size - 10)::DOUBLE AS c6, p_retailprice - 950 AS c12 FROM part)""")
def _(t):
    lj = U.c6_c12_to_lj(F.col("p_size").cast("double") - 10, F.col("p_retailprice") - 950)
    return t.part.select("p_partkey", r(lj["sigma"]).alias("sigma"), r(lj["epsilon"]).alias("epsilon"))


@query("prj14_bonded_units", """
    SELECT p_partkey, round(p_retailprice / (2 * 4.184::DOUBLE * 100), 6) AS k_bond, round(p_retailprice / (2 * 4.184::DOUBLE), 6) AS k_angle,
           round(p_retailprice / 4.184::DOUBLE, 6) AS k_dihedral,
           (CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END * CASE WHEN p_size % 5 - 2 < 0 THEN -1 ELSE 1 END)::BIGINT AS sign
    FROM part""")
def _(t):
    return t.part.select(
        "p_partkey",
        r(F.col("p_retailprice") / F.lit(2 * 4.184 * 100)).alias("k_bond"),
        r(F.col("p_retailprice") / F.lit(2 * 4.184)).alias("k_angle"),
        r(F.col("p_retailprice") / F.lit(4.184)).alias("k_dihedral"),
        U.phase_sign((F.col("p_partkey") % 2) * F.lit(180.0), F.col("p_size") % 5 - 2).alias("sign"),
    )


_PRJ15_SQL = """
    WITH v AS (SELECT frame, bead_id, x - 20 AS ax, y - 25 AS ay, z - 30 AS az, y - 22 AS bx, z - 27 AS bv, x - 24 AS bz,
                      z - 21 AS cx, x - 26 AS cy, y - 28 AS cz FROM fx_beads),
    n AS (SELECT *, ay * bz - az * bv AS mx, az * bx - ax * bz AS my, ax * bv - ay * bx AS mz,
                 bv * cz - bz * cy AS nx, bz * cx - bx * cz AS ny, bx * cy - bv * cx AS nz FROM v)
    SELECT frame, bead_id, round(sqrt(ax * ax + ay * ay + az * az), 5) AS length,
           round(degrees(acos(greatest(-1, least(1, (ax * bx + ay * bv + az * bz)
             / (sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + bv * bv + bz * bz)))))), 5) AS angle,
           round(CASE WHEN mx * cx + my * cy + mz * cz < 0 THEN -1 ELSE 1 END * degrees(acos(greatest(-1, least(1,
             (mx * nx + my * ny + mz * nz) / (sqrt(mx * mx + my * my + mz * mz) * sqrt(nx * nx + ny * ny + nz * nz)))))), 5) AS dihedral
    FROM n"""


@query("prj15_geometry_kernels", _PRJ15_SQL)
def _(t):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    a, b, c = [x - 20, y - 25, z - 30], [y - 22, z - 27, x - 24], [z - 21, x - 26, y - 28]
    return t.beads.select(
        "frame", "bead_id", r(F.sqrt(K.norm2(*a)), 5).alias("length"),
        r(K.angle_deg(a, b), 5).alias("angle"), r(K.dihedral_deg(a, b, c), 5).alias("dihedral"),
    )


@query("prj16_threshold_filters", """
    SELECT l_orderkey, n AS chain_length, round(CASE WHEN abs(d) < 0.2::DOUBLE THEN 0 ELSE d END, 6) AS excess
    FROM (SELECT l_orderkey, count(*) AS n, (sum((l_discount * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE - 5) AS d
          FROM lineitem GROUP BY 1) WHERE n >= 3""")
def _(t):
    chains = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("chain_length"),
        F.sum(F.rint(F.col("l_discount") * 100).cast("bigint")).alias("s"),
    ).where("chain_length >= 3")
    d = F.col("s").cast("double") / F.col("chain_length").cast("double") - 5
    return chains.select("l_orderkey", "chain_length", r(F.when(F.abs(d) < 0.2, 0.0).otherwise(d)).alias("excess"))


@query("prj17_reaction_roles", """
    SELECT frame, CASE WHEN t1 IN (3, 4) THEN a1 ELSE a2 END AS end_bead, CASE WHEN t1 IN (3, 4) THEN a2 ELSE a1 END AS monomer_bead,
           CASE WHEN t1 IN (3, 4) THEN t1 ELSE t2 END AS end_type, CASE WHEN t1 IN (3, 4) THEN t2 ELSE t1 END AS monomer_type
    FROM (SELECT frame, a1, a2, a1 % 6 + 1 AS t1, (a2 * 5 + 2) % 6 + 1 AS t2 FROM fx_after)
    WHERE (t1 IN (3, 4) AND t2 IN (5, 6)) OR (t2 IN (3, 4) AND t1 IN (5, 6))""")
def _(t):
    typed = t.after.withColumn("t1", F.col("a1") % 6 + 1).withColumn("t2", (F.col("a2") * 5 + 2) % 6 + 1)
    return classify.with_roles(typed, K.END_TYPES, K.MONOMER_TYPES).select(
        "frame", "end_bead", "monomer_bead", "end_type", "monomer_type"
    )


_PRJ18_SQL = """
    WITH par AS (SELECT l_suppkey AS k, sum(l_quantity)::DOUBLE / count(*) AS mn,
                        1.1::DOUBLE + (l_suppkey % 10)::DOUBLE / 20 AS pdi FROM lineitem GROUP BY 1),
    g AS (SELECT k, model, i, mn, CASE WHEN model = 'poisson' THEN 1 + 1 / (mn - 1) ELSE pdi END AS pdi2, pdi,
                 1.0::DOUBLE + 99.0::DOUBLE * i / 199.0::DOUBLE AS x
          FROM par, range(200) t(i), (VALUES ('schulz-zimm'), ('poisson'), ('lognormal')) m(model)),
    l AS (SELECT *, CASE model WHEN 'schulz-zimm' THEN (1 / (pdi - 1) - 1) * ln(x) - x / (pdi - 1) / mn
                 WHEN 'poisson' THEN (x - 1) * ln(mn - 1) - (mn - 1) - lgamma(x)
                 ELSE -pow(ln(x) - (ln(mn) - ln(pdi) / 2), 2) / (2 * ln(pdi)) - ln(x) END AS lp FROM g),
    d AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY k, model)) AS d FROM l),
    s AS (SELECT *, (x - lag(x) OVER w) * (d + lag(d) OVER w) / 2 AS s FROM d WINDOW w AS (PARTITION BY k, model ORDER BY i))
    SELECT k, model, i, round(x, 6) AS x, round(d / sum(s) OVER (PARTITION BY k, model), 6) AS p, round(pdi2, 6) AS pdi FROM s"""


@query("prj18_theory_curves", _PRJ18_SQL)
def _(t):
    params = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(
        (F.sum("l_quantity") / F.count(F.lit(1))).alias("mn")
    ).withColumn("pdi", F.lit(1.1) + (F.col("k") % 10).cast("double") / 20)
    return theory_curves(params, ["k"], 200, 1.0, 100.0).select(
        "k", "model", "i", r("x").alias("x"), r("p").alias("p"), r("pdi").alias("pdi")
    )


@query("prj19_safe_ratio", """
    SELECT traj, cycle, round(CASE WHEN N11 > 0 AND N12 > 0 THEN N11::DOUBLE / N12 END, 6) AS r1,
           round(CASE WHEN N22 > 0 AND N21 > 0 THEN N22::DOUBLE / N21 END, 6) AS r2 FROM fx_counts""")
def _(t):
    return t.counts.select(
        "traj", "cycle", r(K.safe_ratio("N11", "N12")).alias("r1"), r(K.safe_ratio("N22", "N21")).alias("r2")
    )


@query("prj20_composition", """
    SELECT traj, cycle, round(f, 6) AS f1, round((2.0::DOUBLE * f * f + f * (1 - f))
             / (2.0::DOUBLE * f * f + 2 * f * (1 - f) + 0.5::DOUBLE * (1 - f) * (1 - f)), 6) AS comp
    FROM (SELECT traj, cycle, n5::DOUBLE / (n5 + n6)::DOUBLE AS f FROM fx_counts)""")
def _(t):
    f1 = F.col("n5").cast("double") / (F.col("n5") + F.col("n6")).cast("double")
    return t.counts.select("traj", "cycle", r(f1).alias("f1"), r(K.instantaneous_composition(f1, 2.0, 0.5)).alias("comp"))


@query("prj21_template_variants", """
    SELECT DISTINCT s_suppkey AS signature, it AS interior, s_suppkey % 2 + 3 AS end_type, (s_nationkey % 2 + 5)::BIGINT AS monomer_type
    FROM (SELECT *, unnest([s_suppkey % 6 + 1, s_nationkey % 6 + 1, (s_suppkey + s_nationkey) % 6 + 1]) AS it FROM supplier)""")
def _(t):
    s, n = F.col("s_suppkey"), F.col("s_nationkey").cast("bigint")
    sig = t.supplier.select(
        s.alias("signature"), F.array_distinct(F.array(s % 6 + 1, n % 6 + 1, (s + n) % 6 + 1)).alias("interior_types"),
        (s % 2 + 3).alias("end_type"), (n % 2 + 5).alias("monomer_type"),
    )
    return classify.template_variants(sig)


@query("prj22_model_evaluation", """
    SELECT table_id, i, form, round(CASE form WHEN 'lj' THEN 4 * 0.3::DOUBLE * (pow(3 / x, 12) - pow(3 / x, 6))
             WHEN 'bond' THEN 2.5::DOUBLE * (x - 3) * (x - 3) + 0.1::DOUBLE
             WHEN 'angle_cos' THEN 2.5::DOUBLE * (1 - cos(radians(x) - radians(3.0::DOUBLE))) + 0.1::DOUBLE
             ELSE 2.5::DOUBLE * (radians(x) - radians(3.0::DOUBLE)) * (radians(x) - radians(3.0::DOUBLE)) + 0.1::DOUBLE END, 6) AS u
    FROM (SELECT *, CASE table_id % 4 WHEN 0 THEN 'lj' WHEN 1 THEN 'bond' WHEN 2 THEN 'angle_cos' ELSE 'angle_harmonic' END AS form
          FROM fx_potentials)""")
def _(t):
    from ..operators.fits import evaluate_model

    m = F.col("table_id") % 4
    form = F.when(m == 0, "lj").when(m == 1, "bond").when(m == 2, "angle_cos").otherwise("angle_harmonic")
    shaped = t.potentials.withColumn("form", form)
    u = evaluate_model("form", "x", k=2.5, x0=3.0, e0=0.1, sigma=3.0, epsilon=0.3)
    return shaped.select("table_id", "i", "form", r(u).alias("u"))
