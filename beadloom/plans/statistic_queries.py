"""Distributions, event statistics, reactivity estimates, quality rules, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.theory import theory_curves
from ..operators import bonded, classify, events, quality, spatial
from ..operators import bonds as B
from ..operators import event_frames as EF
from ..operators import histograms as H
from ..operators import reactivity as R
from ..session import cut_lineage, scratch_path
from ..sources import dump, tables
from .bond_queries import _EXCL_SQL, _pair_sql, bead_chain, bead_exclusions
from .fixtures import BOX, CHECK_STEP, FRAME_BOX, FRAME_BOX_SQL, SQL_FIXTURES
from .registry import ORACLES, QUERIES, query, r

_MI = "({a} - 50.035::DOUBLE * round_even(({a}) / 50.035::DOUBLE, 0))"


def _vec(name, a, b):
    return ", ".join(f"{_MI.format(a=f'({b}.{ax} - {a}.{ax})')} AS {name}{ax}" for ax in "xyz")


def _dot(u, v):
    return " + ".join(f"{u}{ax} * {v}{ax}" for ax in "xyz")


SQL_FIXTURES["fx_bent"] = """
    SELECT frame, bead_id, x + (bead_id * bead_id % 17) * 0.3::DOUBLE AS x, y + (bead_id * bead_id % 23) * 0.2::DOUBLE AS y,
           z + (bead_id * bead_id % 13) * 0.4::DOUBLE AS z FROM fx_beads"""
SQL_FIXTURES["fx_chain4"] = f"""
    SELECT a.frame, a.bead_id AS m1, a.bead_id % 3 + 1 AS type_id, b.bead_id AS m2, c.bead_id AS m3, d.bead_id AS m4,
           {_vec('u', 'a', 'b')}, {_vec('v', 'b', 'c')}, {_vec('w', 'c', 'd')}
    FROM fx_bent a JOIN fx_bent b ON b.frame = a.frame AND b.bead_id = a.bead_id + 1 AND a.bead_id % 10 < 9
    LEFT JOIN fx_bent c ON c.frame = a.frame AND c.bead_id = a.bead_id + 2 AND a.bead_id % 10 < 8
    LEFT JOIN fx_bent d ON d.frame = a.frame AND d.bead_id = a.bead_id + 3 AND a.bead_id % 10 < 7"""
SQL_FIXTURES["fx_terms"] = f"""
    SELECT frame, 'bond' AS kind, type_id, m1, sqrt({_dot('u', 'u')}) AS value FROM fx_chain4
    UNION ALL SELECT frame, 'angle', type_id, m1, degrees(acos(greatest(-1, least(1, -({_dot('u', 'v')})
        / (sqrt({_dot('u', 'u')}) * sqrt({_dot('v', 'v')})))))) FROM fx_chain4 WHERE m3 IS NOT NULL
    UNION ALL SELECT frame, 'dihedral', type_id, m1, CASE WHEN {_dot('p', 'w')} < 0 THEN -1 ELSE 1 END * degrees(acos(greatest(-1, least(1,
        ({_dot('p', 'q')}) / (sqrt({_dot('p', 'p')}) * sqrt({_dot('q', 'q')}))))))
      FROM (SELECT *, uy * vz - uz * vy AS px, uz * vx - ux * vz AS py, ux * vy - uy * vx AS pz,
                   vy * wz - vz * wy AS qx, vz * wx - vx * wz AS qy, vx * wy - vy * wx AS qz FROM fx_chain4) WHERE m4 IS NOT NULL"""


def bonded_values(t):
    """Bond, angle and torsion values of the bead chains in every frame."""
    sq = F.col("bead_id") * F.col("bead_id")
    points = t.beads.select("frame", "bead_id", *[
        (F.col(ax) + (sq % m) * F.lit(w)).alias(ax) for ax, m, w in (("x", 17, 0.3), ("y", 23, 0.2), ("z", 13, 0.4))
    ])
    out = None
    for kind, n in (("bond", 2), ("angle", 3), ("dihedral", 4)):
        members = [f"m{k}" for k in range(1, n + 1)]
        chain = bead_chain(t, n - 1)
        terms = chain.select(*[(F.col("a1") + k).alias(m) for k, m in enumerate(members)], (F.col("a1") % 3 + 1).alias("type_id"))
        part = bonded.term_values(terms, kind, members, points, "bead_id", BOX).select("frame", "kind", "type_id", "m1", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("jn23_bonded_terms", "SELECT frame, kind, type_id, m1, round(value, 5) AS value FROM fx_terms")
def _(t):
    return bonded_values(t).withColumn("value", r("value", 5))


@query("jn24_forcefield_coverage", """
    SELECT kind, combo, count(*) AS n_terms FROM (SELECT 'bond' AS kind, least(a, b)::VARCHAR || '-' || greatest(a, b)::VARCHAR AS combo
      FROM (SELECT l_partkey % 9 AS a, l_suppkey % 7 AS b FROM lineitem)) WHERE combo NOT IN (
      SELECT least(p_partkey % 5, p_size % 5)::VARCHAR || '-' || greatest(p_partkey % 5, p_size % 5)::VARCHAR FROM part) GROUP BY 1, 2""")
def _(t):
    def combos(df, a, b):
        return df.select(F.lit("bond").alias("kind"), K.pair_type(a, b).alias("combo"))

    known = combos(t.part, F.col("p_partkey") % 5, F.col("p_size").cast("bigint") % 5).distinct()
    return quality.missing_parameters(combos(t.lineitem, F.col("l_partkey") % 9, F.col("l_suppkey") % 7), known)


@query("ag5_type_census", "SELECT frame, " + ", ".join(f"count(*) FILTER (WHERE type = {k}) AS n{k}" for k in range(1, 7)) + " FROM fx_beads GROUP BY 1")
def _(t):
    return R.census(t.beads, ["frame"])


_CH_AGG = ", ".join(f"count(*) FILTER (WHERE ch = '{c}') AS N{c}" for c in R.CHANNELS)


@query("ag6_events_per_cycle", f"""
    SELECT g.cycle, {", ".join(f"coalesce(N{c}, 0) AS N{c}" for c in R.CHANNELS)}
    FROM (SELECT unnest(range(1, (SELECT max(cycle) FROM fx_events) + 1)) AS cycle) g
    LEFT JOIN (SELECT cycle, {_CH_AGG} FROM fx_channels GROUP BY 1) USING (cycle)""")
def _(t):
    return events.channel_counts(t.reactions)


@query("ag7_reaction_statistics", """
    WITH c AS (SELECT reaction_type, count(*) AS n FROM fx_events GROUP BY 1)
    SELECT 'share' AS kind, reaction_type AS a, NULL::VARCHAR AS b, n::DOUBLE AS v, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS pct FROM c
    UNION ALL SELECT 'ratio', x.reaction_type, y.reaction_type, round(x.n / greatest(y.n, 1), 6), NULL FROM c x JOIN c y ON x.reaction_type < y.reaction_type
    UNION ALL SELECT 'pair', least(t1, t2)::VARCHAR || '-' || greatest(t1, t2)::VARCHAR, NULL, count(*)::DOUBLE, NULL FROM fx_events GROUP BY ALL
    UNION ALL SELECT 'cycles', NULL, NULL, count(DISTINCT cycle)::DOUBLE, NULL FROM fx_events""")
def _(t):
    none, nod = F.lit(None).cast("string"), F.lit(None).cast("double")
    shares = events.reaction_shares(t.reactions, "reaction_type").select(
        F.lit("share").alias("kind"), F.col("reaction_type").alias("a"), none.alias("b"), F.col("n").cast("double").alias("v"), "pct")
    ratios = events.type_ratios(t.reactions, "reaction_type").select(
        F.lit("ratio").alias("kind"), F.col("num").alias("a"), F.col("den").alias("b"), r("ratio").alias("v"), nod.alias("pct"))
    pairs = events.with_pair_type(t.reactions).groupBy("pair_type").agg(F.count(F.lit(1)).cast("double").alias("v")).select(
        F.lit("pair").alias("kind"), F.col("pair_type").alias("a"), none.alias("b"), "v", nod.alias("pct"))
    cycles = t.reactions.agg(F.count_distinct("cycle").cast("double").alias("v")).select(
        F.lit("cycles").alias("kind"), none.alias("a"), none.alias("b"), "v", nod.alias("pct"))
    return shares.unionByName(ratios).unionByName(pairs).unionByName(cycles)


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("ag8_reactions_by_cycle", "SELECT cycle, " + ", ".join(f"count(*) FILTER (WHERE reaction_type = '{k}') AS {k}" for k in _TYPES) + " FROM fx_events GROUP BY 1")
def _(t):
    return t.reactions.groupBy("cycle").pivot("reaction_type", list(_TYPES)).count().na.fill(0)


@query("ag9_distance_summary", """
    SELECT reaction_type, count(distance) AS n, min(distance) AS lo, max(distance) AS hi, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std
    FROM fx_events WHERE distance IS NOT NULL GROUP BY 1""")
def _(t):
    s = events.distance_summary(t.reactions)
    return s.withColumn("mean", r("mean")).withColumn("std", r("std"))


@query("ag10_chain_length_statistics", """
    SELECT count(*) AS n_chains, sum(n)::BIGINT AS n_units, round(avg(n), 6) AS mn, round(sum(n * n) / sum(n), 6) AS mw,
           round(sum(n * n) / sum(n) / avg(n), 6) AS pdi FROM (SELECT count(*) AS n FROM fx_atoms GROUP BY mol_id) WHERE n >= 2""")
def _(t):
    from ..operators.coarse import molecule_sizes

    out = H.chain_statistics(molecule_sizes(t.atoms).select(F.col("n_atoms").alias("n")), 2)
    return out.select("n_chains", "n_units", r("mn").alias("mn"), r("mw").alias("mw"), r("pdi").alias("pdi"))


_HIST = """
    SELECT k.reaction_type, g.i, 1 + 2.0::DOUBLE * g.i AS x, coalesce(n, 0) AS n, round(coalesce(n, 0) / ({total} * 2.0::DOUBLE), 9) AS density
    FROM (SELECT reaction_type, count(*) FILTER (WHERE distance BETWEEN 0 AND 40) AS n_in, count(*) AS n_all FROM fx_events GROUP BY 1) k
    CROSS JOIN range(20) g(i) LEFT JOIN (SELECT reaction_type, least(floor(distance / 2.0::DOUBLE)::BIGINT, 19) AS i, count(*) AS n
      FROM fx_events WHERE distance BETWEEN 0 AND 40 GROUP BY 1, 2) h ON h.reaction_type = k.reaction_type AND h.i = g.i"""


@query("ag12_histogram_density", _HIST.format(total="n_in"))
def _(t):
    return H.histogram(t.reactions, ["reaction_type"], "distance", 0.0, 40.0, 20).withColumn("density", r("density", 9))


@query("ag13_histogram_all_samples", _HIST.format(total="n_all"))
def _(t):
    return H.histogram(t.reactions, ["reaction_type"], "distance", 0.0, 40.0, 20, basis="all").withColumn("density", r("density", 9))


_RANGES = {"bond": (0.0, 40.0, 40), "angle": (0.0, 180.0, 36), "dihedral": (-180.0, 180.0, 36)}


_TERM_DENSITIES_SQL = """
    SELECT kind, type_id, i, x, n, round(n / (sum_all * w), 9) AS density FROM (
      SELECT kind, type_id, i, lo + (i + 0.5::DOUBLE) * w AS x, w, count(*) AS n, max(c) AS sum_all FROM (
        SELECT t.*, lo, hi, w, count(*) OVER (PARTITION BY kind, type_id) AS c, least(floor((value - lo) / w)::BIGINT, nb - 1) AS i
        FROM fx_terms t JOIN (VALUES ('bond', 0.0::DOUBLE, 40.0::DOUBLE, 1.0::DOUBLE, 40), ('angle', 0, 180, 5, 36), ('dihedral', -180, 180, 10, 36)) v(kind, lo, hi, w, nb) USING (kind))
      WHERE value BETWEEN lo AND hi GROUP BY kind, type_id, i, lo, w)"""


@query("ag17_radial_distribution", f"""
    WITH h AS (SELECT least(ta, tb) AS t1, greatest(ta, tb) AS t2, least(floor(sqrt(d2) / 0.25::DOUBLE)::BIGINT, 23) AS i, count(*) AS n
      FROM ({_pair_sql("a.bead_id < b.bead_id")}) p WHERE sqrt(d2) <= 6
        AND NOT EXISTS (SELECT 1 FROM {_EXCL_SQL} e WHERE e.lo = p.ia AND e.hi = p.ib) GROUP BY ALL),
    c AS (SELECT type, count(*) / 3 AS m FROM fx_beads GROUP BY 1)
    SELECT t1, t2, i, (i + 0.5::DOUBLE) * 0.25::DOUBLE AS r, CASE WHEN t1 = t2 THEN 2 ELSE 1 END * n AS pairs,
           round(CASE WHEN t1 = t2 THEN 2 ELSE 1 END * n / 3 / (4 * pi() * pow((i + 0.5::DOUBLE) * 0.25::DOUBLE, 2) * 0.25::DOUBLE
             * CASE WHEN t1 = t2 THEN a.m * (a.m - 1) ELSE a.m * b.m END / (SELECT avg({" * ".join(v.format(f="f") for v in FRAME_BOX_SQL.values())}) FROM range(3) t(f))), 6) AS g
    FROM h JOIN c a ON a.type = t1 JOIN c b ON b.type = t2""")
def _(t):
    g = spatial.radial_distribution(t.boxed_beads, ["frame"], "bead_id", FRAME_BOX, 6.0, 24, bead_exclusions(t))
    return g.where("pairs > 0").withColumn("g", r("g"))


def _est_sql(n11, n12, n21, n22, e35, e36, e45, e46, n5, n6):
    def sr(a, b):
        return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE END"

    return f"""round({sr(n11, n12)} * ({n6} / {n5}), 6) AS r1_bulk, round({sr(n22, n21)} * ({n5} / {n6}), 6) AS r2_bulk,
        round(({sr(n11, e35)}) / ({sr(n12, e36)}), 6) AS r1_cand, round(({sr(n22, e46)}) / ({sr(n21, e45)}), 6) AS r2_cand"""


_EST = _est_sql("sum(N11)", "sum(N12)", "sum(N21)", "sum(N22)", "sum(E35)", "sum(E36)", "sum(E45)", "sum(E46)", "avg(n5)", "avg(n6)")


def _rounded(df, cols, digits=6):
    return df.select(*[r(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("ag18_point_estimates", f"SELECT traj, {_EST} FROM fx_counts GROUP BY 1")
def _(t):
    return _rounded(R.point_estimates(t.counts, ["traj"]), R.ESTIMATES)


SQL_FIXTURES["fx_series"] = """
    SELECT *, 1 - (n5 + n6)::DOUBLE / first_value(n5 + n6) OVER (PARTITION BY traj ORDER BY cycle)::DOUBLE AS X FROM fx_counts"""
SQL_FIXTURES["fx_windows"] = f"""
    SELECT nw AS n_windows, w AS "window", avg(X) AS X_mid, avg(n5::DOUBLE / (n5 + n6)::DOUBLE) AS f1,
           (sum(N11) + sum(N21))::DOUBLE / nullif(sum(N11 + N12 + N21 + N22), 0)::DOUBLE AS F1_inst, sum(N11 + N12 + N21 + N22)::BIGINT AS n_events, {_EST}
    FROM (SELECT *, greatest(0, least(nw - 1, k0 + CASE WHEN (k0 + 1) * step <= X THEN 1 WHEN k0 * step > X THEN -1 ELSE 0 END)) AS w
      FROM (SELECT s.*, nw, l.x / nw::DOUBLE AS step, floor(s.X / (l.x / nw::DOUBLE))::BIGINT AS k0 FROM fx_series s
        CROSS JOIN (SELECT arg_max(X, traj * 100000 + cycle) AS x FROM fx_series) l CROSS JOIN (SELECT unnest([10, 20, 40])::BIGINT AS nw)))
    GROUP BY 1, 2"""


@query("ag19_window_estimates", """SELECT n_windows, "window", round(X_mid, 6) AS X_mid, round(f1, 6) AS f1, round(F1_inst, 6) AS F1_inst, n_events,
    r1_bulk, r2_bulk, r1_cand, r2_cand FROM fx_windows""")
def _(t):
    return _rounded(R.window_estimates(t.counts, ["traj"], (10, 20, 40)), ("X_mid", "f1", "F1_inst", *R.ESTIMATES))


@query("ag20_channel_rates", """
    SELECT channel, n_events::BIGINT AS n_events, round(n_events / m, 6) AS rho, round(n_events / e, 6) AS pi FROM (
      SELECT '11' AS channel, sum(N11) AS n_events, avg(n5) AS m, sum(E35) AS e FROM fx_counts UNION ALL
      SELECT '12', sum(N12), avg(n6), sum(E36) FROM fx_counts UNION ALL SELECT '21', sum(N21), avg(n5), sum(E45) FROM fx_counts UNION ALL
      SELECT '22', sum(N22), avg(n6), sum(E46) FROM fx_counts)""")
def _(t):
    return _rounded(R.channel_rates(t.counts, ["traj", "cycle"]), ("rho", "pi"))


@query("ag21_run_diagnostics", """
    SELECT count(*) AS n_cycles, sum(N11)::BIGINT AS N11, sum(N12)::BIGINT AS N12, sum(N21)::BIGINT AS N21, sum(N22)::BIGINT AS N22,
           round(sum(N11 + N12 + N21 + N22) / count(*) / (avg(n3) + avg(n4)), 9) AS events_per_active_center,
           round(avg(E35) + avg(E36) + avg(E45) + avg(E46), 6) AS candidate_pairs,
           round((SELECT avg(x) FROM (SELECT arg_max(X, cycle) AS x FROM fx_series GROUP BY traj)), 6) AS conversion_final,
           (SELECT count(*) FROM fx_windows WHERE n_windows = 20 AND n_events = 0) AS zero_event_windows FROM fx_counts""")
def _(t):
    d = R.diagnostics(t.counts, ["traj"])
    return _rounded(_rounded(d, ("events_per_active_center",), 9), ("candidate_pairs", "conversion_final"))


@query("ag22_concentration_report", """
    SELECT quantity, round(arg_min(v, o), 6) AS first, round(arg_max(v, o), 6) AS last, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean, count(v) AS n
    FROM (SELECT traj * 100000 + cycle AS o, 'n5' AS quantity, n5::DOUBLE AS v FROM fx_series UNION ALL SELECT traj * 100000 + cycle, 'n6', n6::DOUBLE FROM fx_series
      UNION ALL SELECT traj * 100000 + cycle, 'n6/n5', n6 / nullif(n5, 0)::DOUBLE FROM fx_series UNION ALL SELECT traj * 100000 + cycle, 'f1', n5 / (n5 + n6)::DOUBLE FROM fx_series
      UNION ALL SELECT traj * 100000 + cycle, 'X', X FROM fx_series) GROUP BY 1""")
def _(t):
    return _rounded(R.concentration_report(t.counts, ["traj"]), ("first", "last", "lo", "hi", "mean"))


_JS = """round(sum(c(p) * log2(c(p) / c(m))) / 2 + sum(c(q) * log2(c(q) / c(m))) / 2, 6) AS js"""
for _v in "pqm":
    _JS = _JS.replace(f"c({_v})", f"greatest(1e-12, least(1, {_v} / (1 + 1e-12)))")


@query("ag23_js_divergence", f"""
    SELECT curve_id, {_JS} FROM (SELECT *, (p + q) / 2 AS m FROM (
      SELECT c.curve_id, p / sum(p) OVER w AS p, n::DOUBLE / sum(n) OVER w AS q FROM fx_curves c JOIN (SELECT i, sum(n) AS n FROM fx_curves GROUP BY 1) t USING (i)
      SELECT_END)) GROUP BY 1""".replace("SELECT_END", "WINDOW w AS (PARTITION BY c.curve_id)").replace("n::DOUBLE / sum(n)", "t.n::DOUBLE / sum(t.n)"))
def _(t):
    whole = t.curves.groupBy("i").agg(F.sum("n").cast("double").alias("q"))
    js = H.js_divergence(t.curves.join(whole, "i"), ["curve_id"])
    return js.select("curve_id", r("js").alias("js"))


@query("ag24_histogram_vs_theory", f"""
    WITH par AS (SELECT curve_id, avg(v) AS mn, sum(v * v) / sum(v) / avg(v) AS pdi FROM fx_samples GROUP BY 1),
    g AS (SELECT curve_id, i, 1.0::DOUBLE + 108.0::DOUBLE * i / 216.0::DOUBLE AS x, mn, pdi FROM par, range(217) t(i)),
    l AS (SELECT *, -pow(ln(x) - (ln(mn) - ln(pdi) / 2), 2) / (2 * ln(pdi)) - ln(x) AS lp FROM g),
    d AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY curve_id)) AS d FROM l),
    s AS (SELECT *, (x - lag(x) OVER w) * (d + lag(d) OVER w) / 2 AS s FROM d WINDOW w AS (PARTITION BY curve_id ORDER BY i)),
    th AS (SELECT curve_id, i, d / sum(s) OVER (PARTITION BY curve_id) AS p FROM s),
    j AS (SELECT c.curve_id, c.p / sum(c.p) OVER w AS p, t.p / sum(t.p) OVER w AS q FROM fx_curves c JOIN th t ON t.curve_id = c.curve_id AND t.i = 2 + 4 * c.i WINDOW w AS (PARTITION BY c.curve_id))
    SELECT curve_id, {_JS} FROM (SELECT *, (p + q) / 2 AS m FROM j) GROUP BY 1""")
def _(t):
    par = t.samples.groupBy("curve_id").agg(
        F.avg("v").alias("mn"), (F.sum(F.col("v") * F.col("v")) / F.sum("v") / F.avg("v")).alias("pdi")
    )
    grid = theory_curves(par, ["curve_id"], 217, 1.0, 109.0).where("model = 'lognormal'").select("curve_id", "i", "x", "p")
    at = H.interpolate_uniform(t.curves.select("curve_id", "x", "p"), grid, ["curve_id"], 1.0, 0.5)
    return H.js_divergence(at, ["curve_id"]).select("curve_id", r("js").alias("js"))


@query("ag25_two_sample_ks", """
    WITH v AS (SELECT reaction_type, distance AS v, 1 AS a, 0 AS b FROM fx_events WHERE event_id % 3 = 0
      UNION ALL SELECT reaction_type, distance * 1.1::DOUBLE, 0, 1 FROM fx_events WHERE event_id % 3 <> 0),
    c AS (SELECT reaction_type, v, sum(sum(a)) OVER w AS ca, sum(sum(b)) OVER w AS cb, sum(sum(a)) OVER p AS n1, sum(sum(b)) OVER p AS n2
      FROM v GROUP BY 1, 2 WINDOW w AS (PARTITION BY reaction_type ORDER BY v), p AS (PARTITION BY reaction_type)),
    d AS (SELECT reaction_type, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, max(abs(ca / n1 - cb / n2)) AS d FROM c GROUP BY 1)
    SELECT reaction_type, n1, n2, round(d, 6) AS d, round(greatest(0, least(1, (SELECT sum((CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END)
      * exp(-2.0::DOUBLE * k * k * (n1 * n2 / (n1 + n2) * d * d))) FROM range(1, 101) t(k)))), 6) AS p_value FROM d""")
def _(t):
    a = t.reactions.where("event_id % 3 = 0").select("reaction_type", "distance")
    b = t.reactions.where("event_id % 3 <> 0").select("reaction_type", (F.col("distance") * F.lit(1.1)).alias("distance"))
    return _rounded(H.ks_two_sample(a, b, ["reaction_type"], "distance", 10.0), ("d", "p_value"))


@query("ag26_kernel_density", """
    WITH s AS (SELECT label, count(*) AS n, stddev_samp(x) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h FROM fx_points GROUP BY 1)
    SELECT label, i, round(any_value(g), 6) AS x, round(sum(exp(-0.5::DOUBLE * pow((g - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
    FROM (SELECT p.label, p.x, n, h, i, -0.6::DOUBLE + i * 1.2::DOUBLE / 299.0::DOUBLE AS g FROM fx_points p JOIN s USING (label) CROSS JOIN range(300) t(i)) GROUP BY 1, 2""")
def _(t):
    kd = H.kernel_density(t.points, ["label"], "x", -0.6, 0.6, 300)
    return kd.select("label", "i", r("x").alias("x"), r("density").alias("density"))


@query("ag27_goodness_of_fit", """
    SELECT table_id, count(*) AS n, round(sqrt(sum(d * d) / count(*)), 6) AS rmse, round(1 - sum(d * d) / (var_pop(u) * count(*)), 6) AS r2
    FROM (SELECT *, u - 4 * 0.3::DOUBLE * (pow(3.2::DOUBLE / x, 12) - pow(3.2::DOUBLE / x, 6)) AS d FROM fx_potentials) GROUP BY 1""")
def _(t):
    from ..operators.fits import lj_energy

    rows = t.potentials.withColumn("fit", lj_energy("x", 3.2, 0.3))
    return _rounded(H.goodness_of_fit(rows, ["table_id"], "u", "fit"), ("rmse", "r2"))


@query("ag30_reaction_count_checks", """
    SELECT n_rows, n_rows = (SELECT count(DISTINCT traj) * max(cycle) FROM fx_events) AS rows_ok, reaction, n_negative, total FROM (
      SELECT count(*) AS n_rows, 'N11' AS reaction, count(*) FILTER (WHERE N11 - 1 < 0) AS n_negative, sum(N11 - 1)::BIGINT AS total FROM fx_counts
      UNION ALL SELECT count(*), 'N22', count(*) FILTER (WHERE N22 < 0), sum(N22)::BIGINT FROM fx_counts)""")
def _(t):
    expected = t.reactions.agg((F.count_distinct("traj") * F.max("cycle")).alias("n")).scalar()
    return quality.reaction_count_checks(t.counts.withColumn("N11", F.col("N11") - 1), ["N11", "N22"], expected)


@query("ag31_mapping_coverage", """
    SELECT (count(*) - count(DISTINCT l_partkey))::BIGINT AS n_duplicates, (max(l_partkey) - count(DISTINCT l_partkey) FILTER (WHERE l_partkey >= 1))::BIGINT AS n_missing,
           count(DISTINCT l_suppkey) AS n_beads FROM lineitem""")
def _(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("atom_id"), F.col("l_suppkey").alias("bead_id"))
    return quality.mapping_coverage(rows, rows.agg(F.max("atom_id").alias("n")).scalar())


@query("ag33_parameter_interning", """
    SELECT o_orderkey, o_orderstatus, o_orderpriority, dense_rank() OVER (ORDER BY f) AS param_id FROM (
      SELECT *, min(o_orderkey) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS f FROM orders)""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return quality.interned_ids(rows, ["o_orderstatus", "o_orderpriority"], "o_orderkey", "param_id")


@query("ag34_box_inference", """
    WITH a AS (SELECT *, CASE WHEN frame = 0 THEN 0 ELSE 45.5::DOUBLE END AS b FROM fx_beads),
    bx AS (SELECT frame, CASE WHEN max(b) = 0 THEN greatest(max(x) - min(x) + 20, 30) ELSE max(b) END AS lx, CASE WHEN max(b) = 0 THEN greatest(max(y) - min(y) + 20, 30) ELSE max(b) END AS ly,
           CASE WHEN max(b) = 0 THEN greatest(max(z) - min(z) + 20, 30) ELSE max(b) END AS lz FROM a GROUP BY 1)
    SELECT frame, round(any_value(lx), 6) AS lx, round(any_value(ly), 6) AS ly, round(any_value(lz), 6) AS lz,
           count(*) FILTER (WHERE x < 0 OR x > lx OR y < 0 OR y > ly OR z < 0 OR z > lz) AS n_outside FROM a JOIN bx USING (frame) GROUP BY 1""")
def _(t):
    box = F.when(F.col("frame") == 0, 0.0).otherwise(45.5)
    atoms = t.beads.select("frame", "x", "y", "z", *[box.alias(b) for b in ("lx", "ly", "lz")])
    boxes = quality.inferred_box(atoms, ["frame"])
    outside = quality.out_of_box(atoms.select("frame", "x", "y", "z"), boxes, ["frame"])
    return _rounded(boxes.join(outside, "frame"), ("lx", "ly", "lz"))


@query("ag35_mass_mismatch", """
    SELECT type, count(*) FILTER (WHERE abs(a.mass - type * 5) > 1e-6) AS n_mismatch, count(*) AS n FROM fx_atoms a GROUP BY 1""")
def _(t):
    masses = t.atoms.select("type").distinct().withColumn("mass", F.col("type") * F.lit(5.0))
    return quality.mass_mismatches(t.atoms, masses)


@query("ag36_config_coverage", """
    WITH s AS (SELECT DISTINCT o_orderkey % 50 AS run, o_orderpriority AS site FROM orders), d AS (SELECT DISTINCT o_orderkey % 50 AS run, o_orderpriority AS site, o_custkey % 40 AS type_id FROM orders WHERE o_orderkey % 7 = 0)
    SELECT run, 'site_without_id' AS rule, site AS detail FROM s ANTI JOIN d USING (run, site)
    UNION ALL SELECT run, 'duplicate_id', type_id::VARCHAR FROM d GROUP BY 1, type_id HAVING count(DISTINCT site) > 1
    UNION ALL SELECT o_orderkey % 50, 'out_of_range', o_orderstatus FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice NOT BETWEEN 1000 AND 400000) OR (o_orderstatus = 'O' AND o_totalprice NOT BETWEEN 2000 AND 300000)""")
def _(t):
    run = (F.col("o_orderkey") % 50).alias("run")
    sites = t.orders.select(run, F.col("o_orderpriority").alias("site")).distinct()
    ids = t.orders.where("o_orderkey % 7 = 0").select(run, F.col("o_orderpriority").alias("site"), (F.col("o_custkey") % 40).alias("type_id")).distinct()
    params = t.orders.select(run, F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("value"))
    ranges = t.spark.createDataFrame([("F", 1000.0, 400000.0), ("O", 2000.0, 300000.0)], "name string, lo double, hi double")
    return quality.config_coverage(sites, ids, params, ranges)


@query("ag37_topology_summary", """
    WITH c AS (SELECT mol_id, count(*) AS n FROM fx_atoms GROUP BY 1)
    SELECT kind, sum(greatest(n - k, 0))::BIGINT AS n_terms, sum(greatest(n - k, 0))::BIGINT AS n_excluded FROM c, (VALUES ('bonds', 1), ('angles', 2), ('dihedrals', 3)) v(kind, k) GROUP BY 1""")
def _(t):
    return quality.topology_summary(t.bonds, B.angles_from_bonds(t.bonds), B.dihedrals_from_bonds(t.bonds))


@query("win1_conversion", "SELECT traj, cycle, round(X, 6) AS X FROM fx_series")
def _(t):
    return R.with_conversion(t.counts, ["traj"]).select("traj", "cycle", r("X").alias("X"))


@query("win2_cumulative_events", f"""
    SELECT traj, cycle, {", ".join(f"(sum(N{c}) OVER w)::BIGINT AS N{c}_cum" for c in R.CHANNELS)}, (sum(N11 + N12 + N21 + N22) OVER w)::BIGINT AS N_total_cum
    FROM fx_counts WINDOW w AS (PARTITION BY traj ORDER BY cycle)""")
def _(t):
    return R.cumulative_events(t.counts, ["traj"]).select("traj", "cycle", *[f"N{c}_cum" for c in R.CHANNELS], "N_total_cum")


@query("win3_global_cycles", """
    SELECT traj, cycle, row_number() OVER (PARTITION BY traj ORDER BY cycle) AS local_cycle, row_number() OVER (ORDER BY traj, cycle) AS cycle_no
    FROM fx_counts""")
def _(t):
    kept = t.counts.select("traj", "cycle")
    return R.global_cycles(kept, "traj", "cycle", block=100)


@query("win20_block_assignment", "SELECT traj, cycle, ntile(7) OVER (PARTITION BY traj ORDER BY cycle) AS block FROM fx_counts")
def _(t):
    return R.with_blocks(t.counts.select("traj", "cycle"), ["traj"], 7, block=100)


@query("win21_frame_guard", """
    SELECT traj, timestep, row_number() OVER (PARTITION BY traj ORDER BY timestep) - 1 AS frame_index, count(*) OVER (PARTITION BY traj) AS n_frames,
           count(*) OVER (PARTITION BY traj) >= 480 AS enough FROM fx_counts WHERE (cycle + traj) % 3 <> 0 OR traj = 1""")
def _(t):
    frames = t.counts.where("(cycle + traj) % 3 <> 0 OR traj = 1").select("traj", "timestep")
    indexed = quality.frame_index(frames, ["traj"], block=100000)
    return indexed.join(quality.frame_guard(frames, ["traj"], 480), "traj")


@query("tk1_ordered_rows", "SELECT frame, bead_id, row_number() OVER (PARTITION BY frame ORDER BY bead_id) AS n FROM fx_beads")
def _(t):
    from ..operators.ordered import bucketed_row_number

    return bucketed_row_number(t.beads.select("frame", "bead_id"), ["frame"], F.floor(F.col("bead_id") / 500), ["bead_id"], "n")


@query("tk2_strided_frames", """
    SELECT traj, timestep, idx // 5 AS frame FROM (SELECT traj, timestep, row_number() OVER (PARTITION BY traj ORDER BY timestep) - 1 AS idx FROM fx_counts) WHERE idx % 5 = 0 AND idx // 5 < 100""")
def _(t):
    from ..sources.dump import strided_frames

    return strided_frames(t.counts.select("traj", "timestep"), ["traj"], stride=5, max_frames=100)


@query("tk3_longest_chains", "SELECT mol_id, count(*) AS n_atoms FROM fx_atoms GROUP BY 1 ORDER BY n_atoms DESC, mol_id LIMIT 10")
def _(t):
    from ..operators.coarse import molecule_sizes

    return molecule_sizes(t.atoms).orderBy(F.desc("n_atoms"), "mol_id").limit(10)


@query("tk4_top_per_group", """
    SELECT reaction_type, event_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY reaction_type ORDER BY distance DESC, event_id) AS rank FROM fx_events) WHERE rank <= 6""")
def _(t):
    rows = t.reactions.select("reaction_type", "event_id", "distance")
    return quality.top_per_group(rows, ["reaction_type"], [F.desc("distance"), "event_id"], 6)


_BOOT_SQL = """
    WITH b AS (SELECT traj, ntile(5) OVER (PARTITION BY traj ORDER BY cycle) AS block, * EXCLUDE (traj) FROM fx_counts),
    s AS (SELECT row_number() OVER (ORDER BY traj, block) - 1 AS idx, sum(N11) AS N11, sum(N12) AS N12, sum(N21) AS N21, sum(N22) AS N22, sum(E35) AS E35, sum(E36) AS E36,
          sum(E45) AS E45, sum(E46) AS E46, sum(n5) AS s5, sum(n6) AS s6, count(*) AS rows FROM b GROUP BY traj, block),
    h0 AS (SELECT rep, slot, rep * 7919 + slot * 104729 AS h FROM range(300) r(rep), range(20) q(slot)),
    h1 AS (SELECT rep, slot, (xor(h, h >> 13) * 1103515245 + 12345) % 2147483648 AS h FROM h0),
    h2 AS (SELECT rep, slot, (xor(h, h >> 13) * 1103515245 + 12345) % 2147483648 AS h FROM h1),
    h3 AS (SELECT rep, slot, (xor(h, h >> 13) * 1103515245 + 12345) % 2147483648 AS h FROM h2),
    e AS (SELECT rep, EST FROM h3 JOIN s ON s.idx = (h3.h >> 12) % 20 GROUP BY 1)
    SELECT estimate, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(v) AS n FROM (
      SELECT 'r1_bulk' AS estimate, r1_bulk AS v FROM e UNION ALL SELECT 'r2_bulk', r2_bulk FROM e UNION ALL SELECT 'r1_cand', r1_cand FROM e UNION ALL SELECT 'r2_cand', r2_cand FROM e)
    WHERE v IS NOT NULL GROUP BY 1""".replace("EST", _est_sql(
        "sum(N11)", "sum(N12)", "sum(N21)", "sum(N22)", "sum(E35)", "sum(E36)", "sum(E45)", "sum(E46)",
        "(sum(s5) / sum(rows))", "(sum(s6) / sum(rows))").replace("round(", "(").replace(", 6)", ")"))


@query("st1_block_bootstrap", _BOOT_SQL)
def _(t):
    return _rounded(R.block_bootstrap(t.counts, ["traj"], 20, 300), ("lo", "hi"))


@query("st2_composition_fit")
def _(t):
    windows = R.window_estimates(t.counts, ["traj"], (10, 20)).select("n_windows", "X_mid", "f1")
    return R.composition_fit(windows, ["n_windows"])


_CYCLE_D2 = " + ".join(f"pow(b.{ax} - a.{ax} - a.l{ax} * round_even((b.{ax} - a.{ax}) / a.l{ax}, 0), 2)" for ax in "xyz")


def cycle_counts(t):
    """Events, candidate pairs and type census per (traj, cycle), from beads and events of every cycle."""
    keys = ["traj", "cycle"]
    pairs = spatial.candidate_pairs(t.cycle_beads, keys, FRAME_BOX, 5.0, K.END_TYPES, K.MONOMER_TYPES)
    types = R.census(t.cycle_beads, keys)
    happened = events.channel_counts(t.reactions, keys)
    full = events.events_on_grid(t.cycle_grid, happened, keys, [f"N{c}" for c in R.CHANNELS])
    return cut_lineage(full.join(pairs, keys).join(types, keys))


@query("st12_reactivity_analysis", f"""
    WITH e AS (SELECT coalesce(sum(n) FILTER (WHERE ta = 3 AND tb = 5), 0) AS E35, coalesce(sum(n) FILTER (WHERE ta = 3 AND tb = 6), 0) AS E36,
               coalesce(sum(n) FILTER (WHERE ta = 4 AND tb = 5), 0) AS E45, coalesce(sum(n) FILTER (WHERE ta = 4 AND tb = 6), 0) AS E46
        FROM (SELECT a.type AS ta, b.type AS tb, count(*) AS n FROM fx_cycle_beads a JOIN fx_cycle_beads b
              ON a.traj = b.traj AND a.cycle = b.cycle AND a.type IN (3, 4) AND b.type IN (5, 6) WHERE {_CYCLE_D2} < 25 GROUP BY ALL)),
    c AS (SELECT count(*) AS n_frames, avg(n5) AS n5, avg(n6) AS n6 FROM (SELECT count(*) FILTER (WHERE type = 5) AS n5, count(*) FILTER (WHERE type = 6) AS n6 FROM fx_cycle_beads GROUP BY traj, cycle)),
    n AS (SELECT {_CH_AGG} FROM fx_channels)
    SELECT n_frames, N11, N12, N21, N22, E35::BIGINT AS E35, E36::BIGINT AS E36, E45::BIGINT AS E45, E46::BIGINT AS E46,
           {_est_sql("N11", "N12", "N21", "N22", "E35", "E36", "E45", "E46", "n5", "n6")} FROM n, e, c""")
def _(t):
    """Point estimates over every cycle of every trajectory, none left out."""
    return _sums_and_estimates(cycle_counts(t), [])


def _sums_and_estimates(counts, keys):
    sums = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), *[F.sum(f"N{c}").alias(f"N{c}") for c in R.CHANNELS], *[F.sum(e).alias(e) for e in R.EXPOSURE.values()],
        F.sum("n5").alias("s5"), F.sum("n6").alias("s6"), F.count(F.lit(1)).alias("rows"))
    shown = [*keys, "n_frames", *[f"N{c}" for c in R.CHANNELS], *R.EXPOSURE.values()]
    return R.estimates_from_sums(sums, shown).select(*shown, *[r(c).alias(c) for c in R.ESTIMATES])


_EVENT_COUNTS_SQL = f"""
    f AS (SELECT DISTINCT traj, cycle FROM fx_events),
    old AS (SELECT traj, cycle, k, (k + cycle) % 9 <> 0 AS stays FROM f, range(239) b(k) WHERE (k + cycle) % 3 = 0),
    made AS (SELECT DISTINCT traj, cycle, least(a, b) AS lo, greatest(a, b) AS hi FROM (
        SELECT traj, cycle, event_id * 7 % 40 * 6 + t1 - 1 AS a, event_id % 40 * 6 + t2 - 1 AS b FROM fx_events)),
    created AS (SELECT m.* FROM made m ANTI JOIN old ON old.traj = m.traj AND old.cycle = m.cycle AND m.lo = k AND m.hi = k + 1),
    typed AS (SELECT c.traj, c.cycle, CASE (least(x.type, y.type), greatest(x.type, y.type)) WHEN (3, 5) THEN '11' WHEN (3, 6) THEN '12' WHEN (4, 5) THEN '21' WHEN (4, 6) THEN '22' END AS ch
        FROM created c JOIN fx_cycle_beads x ON x.traj = c.traj AND x.cycle = c.cycle AND x.bead_id = lo JOIN fx_cycle_beads y ON y.traj = c.traj AND y.cycle = c.cycle AND y.bead_id = hi),
    n AS (SELECT traj, cycle, {", ".join(f"count(*) FILTER (WHERE ch = '{c}') AS N{c}" for c in R.CHANNELS)} FROM typed GROUP BY ALL),
    e AS (SELECT a.traj, a.cycle, {", ".join(f"count(*) FILTER (WHERE a.type = {v[1]} AND b.type = {v[2]}) AS {v}" for v in R.EXPOSURE.values())}
        FROM fx_cycle_beads a JOIN fx_cycle_beads b ON a.traj = b.traj AND a.cycle = b.cycle AND a.type IN (3, 4) AND b.type IN (5, 6) WHERE {_CYCLE_D2} < 25 GROUP BY ALL),
    c AS (SELECT traj, cycle, {", ".join(f"count(*) FILTER (WHERE type = {k}) AS n{k}" for k in range(1, 7))} FROM fx_cycle_beads GROUP BY ALL),
    counts AS (SELECT f.traj, (f.cycle - 1) // 360 + 9 AS chunk, row_number() OVER (PARTITION BY f.traj ORDER BY f.cycle) AS cycle, f.cycle * 1000 AS timestep, n1, n2, n3, n4, n5, n6,
        {", ".join(f"coalesce({v}, 0) AS {v}" for v in [*R.EXPOSURE.values(), *[f"N{c}" for c in R.CHANNELS]])}
        FROM f LEFT JOIN n USING (traj, cycle) LEFT JOIN e USING (traj, cycle) JOIN c USING (traj, cycle))"""


def landed_event_frames(t):
    """Reaction frames and trajectories of an event-driven run written below .../chunk=<n>/md=<n> and read back."""
    keys = list(EF.KEYS)
    before, after = t.event_bonds
    frames, path = scratch_path(t.spark, "reaction-frames"), scratch_path(t.spark, "trajectories")
    pre = t.cycle_beads.join(t.event_frames, ["traj", "cycle"]).select(*keys, "bead_id", F.col("type").alias("bead_type"))
    tables.write_reaction_frames(before, after, frames, pre, keys, ("traj", "chunk"), least_blocks=1)
    atoms = t.event_beads.select("chunk", F.col("traj").alias("md"), "timestep", (F.col("bead_id") + 1).alias("id"), "type", "x", "y", "z", *FRAME_BOX)
    dump.write_dump(atoms, path, FRAME_BOX, by=["chunk", "md"])
    read = lambda member: tables.read_reaction_frames(t.spark, frames, member, keys)
    beads = tables.with_run_path(dump.read_dump(t.spark, path))
    edges = [(F.col(f"box.{ax}hi") - F.col(f"box.{ax}lo")).alias(f"l{ax}") for ax in "xyz"]
    return read("bonds_before"), read("bonds_after"), read("mapping_before"), beads.select(*keys, "type", "x", "y", "z", *edges)


def event_counts(t):
    before, after, types, beads = landed_event_frames(t)
    return EF.event_frame_counts(types.select(*EF.KEYS), before, after, types, beads, FRAME_BOX, 5.0, CHECK_STEP)


@query("st12_aa_event_frames", f"WITH {_EVENT_COUNTS_SQL} SELECT * FROM counts")
def _(t):
    """The second data path of ST12, from landing tables: one row per reaction frame, trajectories chained over their chunks."""
    return event_counts(t)


@query("st12_aa_estimates", f"""WITH {_EVENT_COUNTS_SQL}
    SELECT traj, count(*) AS n_frames, {", ".join(f"sum({v})::BIGINT AS {v}" for v in [*[f"N{c}" for c in R.CHANNELS], *R.EXPOSURE.values()])},
      {_est_sql("sum(N11)", "sum(N12)", "sum(N21)", "sum(N22)", "sum(E35)", "sum(E36)", "sum(E45)", "sum(E46)", "avg(n5)", "avg(n6)")} FROM counts GROUP BY traj""")
def _(t):
    """Reactivity estimates of every trajectory from its reaction frames."""
    return _sums_and_estimates(cut_lineage(event_counts(t)), ["traj"])


@query("st12c_reactivity_report")
def _(t):
    """The whole analysis over every cycle: estimates, bootstrap, windows, fit and diagnostics, as (part, item, name, v)."""
    return reactivity_report(cycle_counts(t), ["traj"])


def reactivity_report(counts, keys, windows=20, n_blocks=20, n_boot=1000):
    def long(df, part, item):
        names = [c for c in df.columns if c not in ("estimate", "n_windows", "window")]
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])
        return df.select(F.lit(part).alias("part"), item.cast("string").alias("item"), F.inline(cells))

    slots = cut_lineage(R.window_estimates(counts, keys, tuple(sorted({10, windows, 40}))))
    fitted = R.composition_fit(slots.where(F.col("n_windows") == windows).select("n_windows", "X_mid", "f1"), ["n_windows"])
    parts = [
        long(R.point_estimates(counts), "estimate", F.lit("all")),
        long(R.block_bootstrap(counts, keys, n_blocks, n_boot), "bootstrap", F.col("estimate")),
        long(slots, "window", F.concat_ws("/", "window", "n_windows")),
        long(fitted, "fit", F.col("n_windows")),
        long(R.diagnostics(counts, keys, windows), "diagnostic", F.lit("all")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("ag14_all_distributions", f"""
    SELECT kind, type_id, NULL::BIGINT AS type_b, i, x, n, density FROM ({_TERM_DENSITIES_SQL})
    UNION ALL SELECT 'rdf', t1, t2, i, r, pairs, g FROM ({ORACLES["ag17_radial_distribution"]})""")
def _(t):
    """Densities of every bonded term, and g(r) per type pair (type_id, type_b) as kind rdf; its n are ordered pairs and its density is g."""
    terms = H.binned_by_kind(bonded_values(t), ["kind", "type_id"], _RANGES).withColumn("density", r("density", 9)).withColumn("type_b", F.lit(None).cast("bigint"))
    radial = QUERIES["ag17_radial_distribution"](t.spark, t.sf_dir).select(
        F.lit("rdf").alias("kind"), F.col("t1").alias("type_id"), F.col("t2").alias("type_b"), "i", F.col("r").alias("x"), F.col("pairs").alias("n"), F.col("g").alias("density"))
    return terms.select("kind", "type_id", "type_b", "i", "x", "n", "density").unionByName(radial)


@query("sf6_json_summary", f"""
    WITH g AS (SELECT traj, cycle % 60 AS part, {_EST.replace(", 6)", ", 4)")}, sum(N11 + N12 + N21 + N22)::BIGINT AS n_events FROM fx_counts GROUP BY ALL)
    SELECT traj, part, json_object('r1_bulk', r1_bulk, 'r2_bulk', r2_bulk, 'r1_cand', r1_cand, 'r2_cand', r2_cand, 'n_events', n_events)::VARCHAR AS summary FROM g""")
def _(t):
    """Estimates of parts of each trajectory as JSON; a ratio that is undefined there is null in it."""
    parts = t.counts.withColumn("part", F.col("cycle") % 60)
    total = parts.groupBy("traj", "part").agg(F.sum(sum((F.col(f"N{c}") for c in R.CHANNELS[1:]), F.col(f"N{R.CHANNELS[0]}"))).alias("n_events"))
    est = R.point_estimates(parts, ["traj", "part"]).select("traj", "part", *[r(c, 4).alias(c) for c in R.ESTIMATES])
    return est.join(total, ["traj", "part"]).select("traj", "part", R.json_summary([*R.ESTIMATES, "n_events"]).alias("summary"))
