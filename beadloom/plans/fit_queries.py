"""Potential tables: features, fits, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits
from .fixtures import SQL_FIXTURES
from .registry import query, r

# A ripple on the pair tables makes shells, so that wells and barriers exist.
SQL_FIXTURES["fx_rippled"] = "SELECT table_id, i, x, u + 0.03::DOUBLE * sin(x * 2.5::DOUBLE) AS u FROM fx_potentials"
SQL_FIXTURES["fx_shifted"] = """
    SELECT p.table_id, i AS j, x, u, u - m AS e FROM fx_rippled p JOIN (SELECT table_id, quantile_cont(u, 0.5) FILTER (WHERE i >= 180) AS m FROM fx_rippled GROUP BY 1) b USING (table_id)"""
SQL_FIXTURES["fx_features"] = """
    SELECT table_id, r_min, e_min, min(xc) AS sigma, coalesce(max(nx) FILTER (WHERE x > r_min AND e < -greatest(1e-3, abs(e_min) * 0.01::DOUBLE)), max(x)) AS cutoff,
           list_sort(list(x) FILTER (WHERE flip))[2] AS x_inflection
    FROM (SELECT *, arg_min(x, e) OVER (PARTITION BY table_id) AS r_min, min(e) OVER (PARTITION BY table_id) AS e_min, sign(d) <> sign(lag(d) OVER w) AS flip FROM (
      SELECT *, coalesce(lead(x) OVER w, x) AS nx, CASE WHEN e > 0 AND lead(e) OVER w <= 0 THEN x + e / (e - lead(e) OVER w) * (lead(x) OVER w - x) END AS xc,
             lead(e) OVER w - e * 2 + lag(e) OVER w AS d FROM fx_shifted WINDOW w AS (PARTITION BY table_id ORDER BY x)) WINDOW w AS (PARTITION BY table_id ORDER BY x))
    GROUP BY 1, 2, 3"""
SQL_FIXTURES["fx_angles"] = """
    SELECT table_id, i, 60 + i * 0.6::DOUBLE AS x, 2 * (1 - cos(radians(60 + i * 0.6::DOUBLE) - radians(115.0::DOUBLE + table_id % 9)))
           + CASE WHEN table_id % 3 = 0 THEN 6 * pow(radians(60 + i * 0.6::DOUBLE) - radians(115.0::DOUBLE + table_id % 9), 4) ELSE 0 END + 0.02::DOUBLE * u / (1 + abs(u)) AS u FROM fx_potentials"""


def rippled(t):
    return t.potentials.withColumn("u", F.col("u") + F.lit(0.03) * F.sin(F.col("x") * 2.5))


def angles(t):
    x = F.lit(60.0) + F.col("i").cast("double") * F.lit(0.6)
    d = F.radians(x) - F.radians(F.lit(115.0) + F.col("table_id") % 9)
    quartic = F.when(F.col("table_id") % 3 == 0, F.lit(6.0) * F.pow(d, F.lit(4.0))).otherwise(0.0)
    u = F.lit(2.0) * (F.lit(1.0) - F.cos(d)) + quartic + F.lit(0.02) * F.col("u") / (F.abs("u") + 1)
    return t.potentials.select("table_id", "i", x.alias("x"), u.alias("u"))


def _round(df, digits=4):
    return df.select(*[r(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("win19_curve_features", """
    SELECT table_id, round(r_min, 4) AS r_min, round(e_min, 4) AS e_min, round(sigma, 4) AS sigma, round(cutoff, 4) AS cutoff, round(x_inflection, 4) AS x_inflection FROM fx_features""")
def _(t):
    f = fits.curve_features(fits.tail_shift(rippled(t), ("table_id",), "median"))
    return _round(f.select("table_id", "r_min", "e_min", "sigma", "cutoff", "x_inflection"))


@query("st5_bond_fit", """
    WITH w AS (SELECT table_id, x, u, x - avg(x) OVER (PARTITION BY table_id) AS t, avg(x) OVER (PARTITION BY table_id) AS c FROM (
        SELECT *, min(u) OVER (PARTITION BY table_id) AS low FROM fx_potentials) WHERE u - low <= 0.05::DOUBLE),
    s AS (SELECT table_id, any_value(c) AS c, count(*) AS n, sum(t * t) AS s2, sum(t * t * t) AS s3, sum(t * t * t * t) AS s4, sum(u) AS t0, sum(u * t) AS t1, sum(u * t * t) AS t2 FROM w GROUP BY 1),
    k AS (SELECT *, (n * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / (n * (s2 * s4 - s3 * s3) - s2 * s2 * s2) AS c2 FROM s),
    p AS (SELECT *, (t1 - s3 * c2) / s2 AS c1, (t0 - s2 * c2) / n AS c0 FROM k),
    f AS (SELECT table_id, n, c2 AS k, c - c1 / (2 * c2) AS r0, c0 - c1 * c1 / (4 * c2) AS e0 FROM p)
    SELECT table_id, any_value(n) AS n_fit, round(any_value(k), 4) AS k, round(any_value(r0), 4) AS r0, round(any_value(e0), 4) AS e0,
           round(sqrt(avg(pow(u - k * (x - r0) * (x - r0) - e0, 2))), 4) AS rmse, round(1 - sum(pow(u - k * (x - r0) * (x - r0) - e0, 2)) / (var_pop(u) * count(*)), 4) AS r2
    FROM w JOIN f USING (table_id) GROUP BY 1""")
def _(t):
    return _round(fits.fit_bond(t.potentials, 0.05))


@query("st6_angle_fit", """
    WITH w AS (SELECT table_id, x, u, radians(x) AS th, cos(radians(x)) AS co, sin(radians(x)) AS si FROM (SELECT *, min(u) OVER (PARTITION BY table_id) AS low FROM fx_angles) WHERE u - low <= 1.5::DOUBLE),
    v AS (SELECT *, th - avg(th) OVER p AS t, avg(th) OVER p AS c, co - avg(co) OVER p AS dc, si - avg(si) OVER p AS ds, u - avg(u) OVER p AS du FROM w WINDOW p AS (PARTITION BY table_id)),
    s AS (SELECT table_id, count(*) AS n, any_value(c) AS c, sum(t * t) AS s2, sum(t * t * t) AS s3, sum(t * t * t * t) AS s4, sum(u) AS t0, sum(u * t) AS t1, sum(u * t * t) AS t2,
            sum(dc * dc) AS cc, sum(ds * ds) AS ss, sum(dc * ds) AS cs, sum(dc * du) AS cu, sum(ds * du) AS su, avg(u) AS mu, avg(co) AS mc, avg(si) AS ms FROM v GROUP BY 1),
    k AS (SELECT *, (n * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / (n * (s2 * s4 - s3 * s3) - s2 * s2 * s2) AS c2, (cu * ss - su * cs) / (cc * ss - cs * cs) AS b, (su * cc - cu * cs) / (cc * ss - cs * cs) AS d FROM s),
    p AS (SELECT *, (t1 - s3 * c2) / s2 AS c1, (t0 - s2 * c2) / n AS c0, sqrt(b * b + d * d) AS kc, atan2(-d, -b) AS tc FROM k),
    f AS (SELECT table_id, n, c2 AS kh, c - c1 / (2 * c2) AS thh, c0 - c1 * c1 / (4 * c2) AS eh, kc, tc, mu - b * mc - d * ms - kc AS ec FROM p),
    q AS (SELECT table_id, sqrt(avg(pow(u - kc * (1 - cos(th - tc)) - ec, 2))) AS qc, sqrt(avg(pow(u - kh * (th - thh) * (th - thh) - eh, 2))) AS qh, var_pop(u) AS vv FROM w JOIN f USING (table_id) GROUP BY 1),
    z AS (SELECT *, qc <= 2 * qh AS uc FROM f JOIN q USING (table_id))
    SELECT table_id, n AS n_fit, CASE WHEN uc THEN 'angle_cos' ELSE 'angle_harmonic' END AS form, round(CASE WHEN uc THEN kc ELSE kh END, 4) AS k, round(degrees(CASE WHEN uc THEN tc ELSE thh END), 4) AS theta0,
           round(CASE WHEN uc THEN ec ELSE eh END, 4) AS e0, round(CASE WHEN uc THEN qc ELSE qh END, 4) AS rmse, round(1 - pow(CASE WHEN uc THEN qc ELSE qh END, 2) / vv, 4) AS r2 FROM z""")
def _(t):
    return _round(fits.fit_angle(angles(t), 1.5))


@query("st7_lj_search", """
    WITH b AS (SELECT *, min(u) OVER (PARTITION BY table_id) AS em, arg_min(x, u) OVER (PARTITION BY table_id) AS r0, lead(x) OVER (PARTITION BY table_id ORDER BY x) AS nx FROM fx_rippled),
    g0 AS (SELECT table_id, any_value(r0) AS r0, coalesce(max(x) FILTER (WHERE x < r0 AND u >= 2), min(x)) AS x0,
             coalesce(max(coalesce(nx, x)) FILTER (WHERE x > r0 AND u < -greatest(1e-3, abs(em) * 0.01::DOUBLE)), max(x)) AS cut FROM b GROUP BY 1),
    g AS (SELECT *, CASE WHEN a = 5 THEN r0 ELSE x0 + (r0 - x0) / 5.0::DOUBLE * a END AS l, CASE WHEN bb = 11 THEN cut ELSE r0 + (cut - r0) / 11.0::DOUBLE * bb END AS h FROM g0, range(6) p(a), range(1, 12) q(bb)),
    s AS (SELECT table_id, a, bb, l, h, r0, count(*) AS n, sum(q * q * q * q) AS pp, sum(q * q * q) AS pq, sum(q * q) AS qq, sum(q * q * u) AS pe, sum(q * u) AS qe FROM (
        SELECT g.*, u, pow(r0 / x, 6) AS q FROM g JOIN fx_rippled p ON p.table_id = g.table_id AND x >= l AND x <= h WHERE h > l) GROUP BY ALL HAVING count(*) >= 5),
    f AS (SELECT *, (pe * qq - qe * pq) / (pp * qq - pq * pq) AS aa, -(qe * pp - pe * pq) / (pp * qq - pq * pq) AS ab FROM s),
    z AS (SELECT table_id, a, bb, l, h, r0 * pow(aa / ab, 1.0::DOUBLE / 6) AS sg, ab * ab / (4 * aa) AS ep FROM f WHERE aa > 0 AND ab > 0),
    e AS (SELECT z.table_id, a, bb, l, h, sg, ep, sum(d * d) AS ssr, var_pop(u) * count(*) AS sst, count(*) AS n FROM (SELECT z.*, u, u - 4 * ep * (pow(sg / x, 12) - pow(sg / x, 6)) AS d
        FROM z JOIN fx_rippled p USING (table_id) JOIN g0 USING (table_id) WHERE u <= 3 OR x > cut) z GROUP BY ALL)
    SELECT table_id, round(any_value(cut), 4) AS cutoff, round(arg_max(l, k), 4) AS left, round(arg_max(h, k), 4) AS right, round(arg_max(sg, k), 4) AS sigma, round(arg_max(ep, k), 4) AS epsilon,
           round(arg_max(sqrt(ssr / n), k), 4) AS rmse, round(arg_max(1 - ssr / sst, k), 4) AS r2 FROM (SELECT *, (1 - ssr / sst, -a, -bb) AS k FROM e) JOIN g0 USING (table_id) GROUP BY 1""")
def _(t):
    return _round(fits.lj_search(rippled(t)))


@query("st8_lj_readoff", """
    WITH dv AS (SELECT *, lead(e) OVER w - e AS up, e - lag(e) OVER w AS dn, lag(e) OVER w AS pe, lag(x) OVER w AS px FROM fx_shifted WINDOW w AS (PARTITION BY table_id ORDER BY j)),
    st AS (SELECT table_id, min(j) AS s FROM dv WHERE e < 2 GROUP BY 1),
    wl AS (SELECT table_id, min(j) AS jw FROM dv JOIN st USING (table_id) WHERE j > s AND dn < 0 AND up > 0 GROUP BY 1),
    br AS (SELECT table_id, min(j) AS jb FROM dv JOIN wl USING (table_id) WHERE j > jw AND dn > 0 AND up < 0 GROUP BY 1),
    m AS (SELECT table_id, s, jw, jb, a.x AS xw, a.e AS ew, b.x AS xb, b.e AS eb FROM st JOIN wl USING (table_id) JOIN br USING (table_id) JOIN dv a USING (table_id) JOIN dv b USING (table_id) WHERE a.j = jw AND b.j = jb),
    h AS (SELECT table_id, min(j) AS jh FROM dv JOIN m USING (table_id) WHERE j >= s AND j <= jw AND e <= eb GROUP BY 1),
    wp AS (SELECT table_id, px + (pe - eb) / (pe - e) * (x - px) AS sg, eb - ew AS ep, xw, xb, eb FROM m JOIN h USING (table_id) JOIN dv USING (table_id) WHERE dv.j = jh),
    wq AS (SELECT table_id, sqrt(avg(d * d)) AS rmse FROM (SELECT table_id, e - eb - 4 * ep * (pow(sg / x, 12) - pow(sg / x, 6)) AS d FROM dv JOIN wp USING (table_id) WHERE e <= 3 AND x <= xb) GROUP BY 1),
    dq AS (SELECT table_id, sqrt(avg(d * d)) AS rmse FROM (SELECT table_id, e - 4 * -e_min * (pow(sigma / x, 12) - pow(sigma / x, 6)) AS d FROM fx_shifted JOIN fx_features USING (table_id) WHERE e <= 3 OR x > cutoff) GROUP BY 1)
    SELECT 'direct' AS method, table_id, round(sigma, 4) AS sigma, round(-e_min, 4) AS epsilon, round(r_min, 4) AS r_min, round(cutoff, 4) AS cutoff, round(rmse, 4) AS rmse FROM fx_features JOIN dq USING (table_id)
    UNION ALL SELECT 'well', table_id, round(sg, 4), round(ep, 4), round(xw, 4), round(xb, 4), round(rmse, 4) FROM wp JOIN wq USING (table_id)""")
def _(t):
    cols = ["table_id", "sigma", "epsilon", "r_min", "cutoff", "rmse"]
    direct = _round(fits.lj_direct(rippled(t)).select(*cols)).withColumn("method", F.lit("direct"))
    well = _round(fits.lj_well(rippled(t)).select(*cols)).withColumn("method", F.lit("well"))
    return direct.unionByName(well)


def _mixed(t):
    pairs = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return fits.mix_tables(t.potentials, pairs)


@query("st9_table_mixing")
def _(t):
    return _mixed(t)


@query("st9_mixing_checks")
def _(t):
    return fits.mixing_checks(_mixed(t))
