"""Curve processing: forces, ranges, peaks, smoothing, inversion, quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import histograms as H
from ..session import cut_lineage
from .fixtures import SQL_FIXTURES
from .registry import query, r

_KT = repr(C.KT) + "::DOUBLE"


def _grad(v, x="x"):
    f0, f1, x0, x1 = (f"{fn}({c}) OVER w" for c in (v, x) for fn in ("lag", "lead"))
    hs, hd = f"({x} - {x0})", f"({x1} - {x})"
    return (
        f"CASE WHEN {x0} IS NULL THEN ({f1} - {v}) / {hd} WHEN {x1} IS NULL THEN ({v} - {f0}) / {hs} "
        f"ELSE ({hs} * {hs} * {f1} + ({hd} * {hd} - {hs} * {hs}) * {v} - {hd} * {hd} * {f0}) / ({hs} * {hd} * ({hd} + {hs})) END"
    )


_W = "WINDOW w AS (PARTITION BY {k} ORDER BY i)"
_WC = _W.format(k="curve_id")

SQL_FIXTURES["fx_cn"] = "SELECT curve_id, i, x, n::DOUBLE AS p FROM fx_curves"
SQL_FIXTURES["fx_range"] = """
    SELECT curve_id, min(i) FILTER (WHERE c >= (1 - 0.99::DOUBLE) / 2) AS i_start, min(i) FILTER (WHERE c >= 1 - (1 - 0.99::DOUBLE) / 2) AS i_end
    FROM (SELECT curve_id, i, sum(p) OVER (PARTITION BY curve_id ORDER BY i) / sum(p) OVER (PARTITION BY curve_id) AS c FROM fx_cn) GROUP BY 1"""
SQL_FIXTURES["fx_peaks"] = f"""
    SELECT curve_id, i, x, p AS height, row_number() OVER (PARTITION BY curve_id ORDER BY i) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY p DESC, i DESC) AS r FROM (
        SELECT *, lead(g) OVER w AS g1 FROM (SELECT *, {_grad('p')} AS g, max(p) OVER (PARTITION BY curve_id) AS top FROM fx_cn {_WC}) {_WC})
      WHERE g > 0 AND g1 <= 0 AND p >= 0.01::DOUBLE * top) WHERE r <= 6"""
SQL_FIXTURES["fx_width"] = """
    SELECT c.curve_id, coalesce(any_value(m), (max(x) - min(x)) * 0.05::DOUBLE) AS width FROM fx_cn c LEFT JOIN (
      SELECT curve_id, avg(wd) AS m FROM (SELECT k.curve_id, k.i, coalesce(arg_min(c.x, c.i) FILTER (WHERE c.i > k.i AND c.p < height / 2), k.x)
          - coalesce(arg_max(c.x, c.i) FILTER (WHERE c.i < k.i AND c.p < height / 2), k.x) AS wd
        FROM fx_peaks k JOIN fx_cn c USING (curve_id) GROUP BY k.curve_id, k.i, k.x) WHERE wd > 0 GROUP BY 1) q ON q.curve_id = c.curve_id GROUP BY 1"""
SQL_FIXTURES["fx_zones"] = """
    SELECT c.curve_id, c.i, c.x, c.p, CASE WHEN c.i > i_end THEN 4 WHEN c.i BETWEEN i_start AND i_end THEN
        CASE WHEN EXISTS (SELECT 1 FROM fx_peaks k WHERE k.curve_id = c.curve_id AND k.i BETWEEN i_start AND i_end AND abs(c.x - k.x) <= width / 2) THEN 1 ELSE 2 END
      ELSE 0 END AS zone FROM fx_cn c JOIN fx_range USING (curve_id) JOIN fx_width USING (curve_id)"""


def counts_as_p(t):
    return t.curves.select("curve_id", "i", "x", F.col("n").cast("double").alias("p"))


def _round(df, *cols, digits=6):
    return df.select(*[r(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("win4_force", f"""
    SELECT table_id, i, round(f, 6) AS f, round({_grad('g')}, 4) AS d2f FROM (
      SELECT *, {_grad('f')} AS g FROM (SELECT *, -({_grad('u')}) AS f FROM fx_potentials {_W.format(k='table_id')}) {_W.format(k='table_id')}) {_W.format(k='table_id')}""")
def _(t):
    out = C.with_force(t.potentials, "u", ("table_id",))
    return out.select("table_id", "i", r("f").alias("f"), r("d2f", 4).alias("d2f"))


@query("win5_gap_fill", """
    SELECT table_id, i, round(coalesce(u, (lag(u) OVER w + lead(u) OVER w) / 2), 6) AS u
    FROM (SELECT table_id, i, CASE WHEN (i * 7 + table_id) % 5 = 0 OR i < 3 THEN NULL ELSE u END AS u FROM fx_potentials) WINDOW w AS (PARTITION BY table_id ORDER BY i)""")
def _(t):
    holes = t.potentials.withColumn("u", F.when(((F.col("i") * 7 + F.col("table_id")) % 5 == 0) | (F.col("i") < 3), None).otherwise(F.col("u")))
    return C.fill_isolated_gaps(holes, "u", ("table_id",)).select("table_id", "i", r("u").alias("u"))


@query("win6_normalisation", f"""
    SELECT curve_id, i, round(p / sum(s) OVER (PARTITION BY curve_id), 9) AS by_area, round(p / max(p) OVER (PARTITION BY curve_id), 9) AS by_max
    FROM (SELECT *, (x - lag(x) OVER w) * (p + lag(p) OVER w) / 2 AS s FROM fx_cn {_WC})""")
def _(t):
    c = counts_as_p(t)
    area = H.normalise_curve(c, "area").select("curve_id", "i", r("p", 9).alias("by_area"))
    top = H.normalise_curve(c, "max").select("curve_id", "i", r("p", 9).alias("by_max"))
    return area.join(top, ["curve_id", "i"])


@query("win7_valid_range", "SELECT curve_id, i_start, i_end FROM fx_range")
def _(t):
    return C.with_valid_range(counts_as_p(t)).select("curve_id", "i_start", "i_end").distinct()


@query("win8_zero_interpolation", """
    WITH g AS (SELECT c.*, c.i BETWEEN i_start AND i_end AS ins, c.i BETWEEN i_start AND i_end AND p >= 9 AS ok FROM fx_cn c JOIN fx_range USING (curve_id)),
    f AS (SELECT *, max(CASE WHEN ok THEN i END) OVER (PARTITION BY curve_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
                 min(CASE WHEN ok THEN i END) OVER (PARTITION BY curve_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS h FROM g)
    SELECT f.curve_id, f.i, round(CASE WHEN f.ins AND f.p < 9 AND l IS NOT NULL AND h IS NOT NULL
        THEN a.p + (f.x - a.x) / (b.x - a.x) * (b.p - a.p) ELSE f.p END, 6) AS p
    FROM f LEFT JOIN g a ON a.curve_id = f.curve_id AND a.i = l LEFT JOIN g b ON b.curve_id = f.curve_id AND b.i = h""")
def _(t):
    return C.interpolate_zeros(C.with_valid_range(counts_as_p(t)), 9.0).select("curve_id", "i", r("p").alias("p"))


@query("win9_peaks", "SELECT curve_id, i, x, height, rank FROM fx_peaks")
def _(t):
    return C.detect_peaks(counts_as_p(t))


@query("win10_prominent_peaks", f"""
    WITH r AS (SELECT *, sum(new) OVER (PARTITION BY curve_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN p = lag(p) OVER w THEN 0 ELSE 1 END AS new FROM fx_cn {_WC})),
    f AS (SELECT curve_id, run, min(i) AS a, max(i) AS b, any_value(p) AS h FROM r GROUP BY 1, 2),
    k AS (SELECT curve_id, (a + b) // 2 AS i, h, top FROM (SELECT *, lag(h) OVER v AS hl, lead(h) OVER v AS hr, max(h) OVER (PARTITION BY curve_id) AS top FROM f
      WINDOW v AS (PARTITION BY curve_id ORDER BY run)) WHERE h > hl AND h > hr),
    wl AS (SELECT k.curve_id, k.i, k.h, k.top, coalesce(max(c.i) FILTER (WHERE c.p > h AND c.i < k.i), -1) AS lo, coalesce(min(c.i) FILTER (WHERE c.p > h AND c.i > k.i), 999) AS hi
      FROM k JOIN fx_cn c USING (curve_id) GROUP BY ALL)
    SELECT * FROM (SELECT w.curve_id, w.i, w.h AS height, w.h - greatest(min(c.p) FILTER (WHERE c.i > lo AND c.i <= w.i), min(c.p) FILTER (WHERE c.i < hi AND c.i >= w.i)) AS prominence, top
      FROM wl w JOIN fx_cn c USING (curve_id) GROUP BY w.curve_id, w.i, w.h, w.top) WHERE prominence >= 0.1::DOUBLE * top""".replace("SELECT * FROM (SELECT w.", "SELECT * EXCLUDE (top) FROM (SELECT w."))
def _(t):
    return C.prominent_peaks(counts_as_p(t))


@query("win11_peak_width", "SELECT curve_id, round(width, 6) AS width FROM fx_width")
def _(t):
    c = counts_as_p(t)
    return _round(C.peak_width(c, C.detect_peaks(c)), "width")


def _savgol_sql(window: int, order: int, n: int = 54) -> str:
    """Value at place ``pos`` of the cubic fitted to the window around a point, or to the first or last window near the ends."""
    powers = np.vander(np.arange(window) / window, order + 1)
    hat = powers @ np.linalg.pinv(powers)
    rows = ", ".join(f"({pos}, {k}, {hat[pos, k]!r}::DOUBLE)" for pos in range(window) for k in range(window)).replace("np.float64", "")
    start = f"least(greatest(c.i - {window // 2}, 0), {n - window})"
    return f"""SELECT c.curve_id, c.i, c.x, round(sum(w.w * s.p), 6) AS smooth FROM fx_cn c
        JOIN (VALUES {rows}) w(pos, k, w) ON w.pos = c.i - {start}
        JOIN fx_cn s ON s.curve_id = c.curve_id AND s.i = {start} + w.k GROUP BY 1, 2, 3"""


@query("win13_savgol_smoothing", _savgol_sql(11, 3))
def _(t):
    arrays = C.to_arrays(counts_as_p(t)).withColumn("smooth", C.savgol_smooth("ps", 11, 3))
    return _round(C.from_arrays(arrays, ["smooth"]), "smooth")


def _gauss_sql(sigma, periodic=False):
    radius = int(4.0 * sigma + 0.5)
    index = "(c.i + k.k + 108) % 54" if periodic else "CASE WHEN (c.i + k.k + 216) % 108 < 54 THEN (c.i + k.k + 216) % 108 ELSE 107 - (c.i + k.k + 216) % 108 END"
    return f"""SELECT c.curve_id, c.i, c.x, sum(w * s.p) AS p FROM fx_cn c CROSS JOIN (
        SELECT k, exp(-0.5::DOUBLE * pow(k / {sigma}::DOUBLE, 2)) / sum(exp(-0.5::DOUBLE * pow(k / {sigma}::DOUBLE, 2))) OVER () AS w FROM range(-{radius}, {radius + 1}) t(k)) k
        JOIN fx_cn s ON s.curve_id = c.curve_id AND s.i = {index} GROUP BY 1, 2, 3"""


@query("win14_gaussian_smoothing", f"""
    SELECT a.curve_id, a.i, round(a.p, 6) AS mirrored, round(b.p, 6) AS periodic FROM ({_gauss_sql(2.0)}) a JOIN ({_gauss_sql(2.0, True)}) b USING (curve_id, i)""")
def _(t):
    arrays = C.to_arrays(counts_as_p(t)).withColumn("mirrored", C.gaussian_smooth("ps", 2.0)).withColumn("periodic", C.gaussian_smooth("ps", 2.0, True))
    return _round(C.from_arrays(arrays, ["mirrored", "periodic"]), "mirrored", "periodic").drop("x")


_SIGMAS = [0.5, 1.0, 2.0, 3.0, 5.0]


@query("win15_sigma_selection", """
    WITH """ + ", ".join(f"s{n} AS ({_gauss_sql(s)})" for n, s in enumerate(_SIGMAS)) + ", al AS (" + " UNION ALL ".join(
        f"SELECT curve_id, i, x, p, {n} AS ord, {s}::DOUBLE AS sigma FROM s{n}" for n, s in enumerate(_SIGMAS)) + f"""),
    g AS (SELECT *, {_grad('p')} AS g, max(p) OVER (PARTITION BY curve_id, ord) AS top FROM al {_W.format(k='curve_id, ord')}),
    c AS (SELECT curve_id, ord, sigma, least(6, count(*) FILTER (WHERE g > 0 AND g1 <= 0 AND p >= 0.01::DOUBLE * top)) AS n
      FROM (SELECT *, lead(g) OVER w AS g1 FROM g {_W.format(k='curve_id, ord')}) GROUP BY 1, 2, 3),
    b AS (SELECT curve_id, arg_min((sigma, n), CASE WHEN n <= 2 THEN ord ELSE 1000 + n * 10 + ord END) AS b FROM c GROUP BY 1)
    SELECT curve_id, b[1] AS sigma, b[2]::BIGINT AS n_peaks FROM b""")
def _(t):
    return C.select_sigma(counts_as_p(t), _SIGMAS, F.lit(2)).select("curve_id", "sigma", "n_peaks")


def _rough_sql(source, keys):
    w = _W.format(k=keys)
    return f"""SELECT {keys}, sum(d2f * d2f) * 2.0::DOUBLE AS rough FROM (SELECT {keys}, {_grad('g')} AS d2f FROM (SELECT *, {_grad('f')} AS g FROM (
      SELECT *, -({_grad('u')}) AS f FROM (SELECT *, -{C.KT!r}::DOUBLE * ln(greatest(p, 1e-15)) AS u FROM {source}) {w}) {w}) {w}) GROUP BY {keys}"""


@query("win15_best_score", """
    WITH """ + ", ".join(f"s{n} AS ({_gauss_sql(s, True)})" for n, s in enumerate(_SIGMAS)) + ", al AS (" + " UNION ALL ".join(
        f"SELECT curve_id, i, x, greatest(p, 0) AS p, {n} AS ord, {s}::DOUBLE AS sigma FROM s{n}" for n, s in enumerate(_SIGMAS)) + f"""),
    a AS ({_rough_sql("al", "curve_id, ord")}), b AS ({_rough_sql("fx_cn", "curve_id")}),
    l AS (SELECT curve_id, ord, any_value(sigma) AS sigma, corr(CASE WHEN c.p > 1e-10 THEN c.p END, CASE WHEN c.p > 1e-10 THEN al.p END) AS c, count(*) FILTER (WHERE c.p > 1e-10) AS m,
        abs(arg_min(al.p, i) - arg_max(al.p, i)) AS d FROM al JOIN fx_cn c USING (curve_id, i) GROUP BY ALL),
    s AS (SELECT curve_id, ord, sigma, CASE WHEN b.rough > 0 THEN (b.rough - a.rough) / b.rough ELSE 0 END * pow(CASE WHEN m > 10 AND NOT isnan(coalesce(c, 'nan'::DOUBLE)) THEN c ELSE 0.5 END, 2) / (1 + 1000 * d) AS score
        FROM l JOIN a USING (curve_id, ord) JOIN b USING (curve_id))
    SELECT curve_id, sigma, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY curve_id ORDER BY score DESC, ord) = 1""")
def _(t):
    return _round(C.select_sigma_by_score(counts_as_p(t), _SIGMAS).select("curve_id", "sigma", "score"), "score")


def zoned(t, kind="bond"):
    c = C.with_valid_range(counts_as_p(t))
    peaks = C.detect_peaks(c)
    return C.with_zones(c, peaks, C.peak_width(c, peaks), kind)


@query("win16_zone_mask", "SELECT curve_id, i, zone::BIGINT AS zone FROM fx_zones")
def _(t):
    return zoned(t).select("curve_id", "i", "zone")


@query("win17_zone_borders", """
    SELECT curve_id, i, round(CASE WHEN (ch OR lag(ch, 1, false) OVER w OR lead(ch, 1, false) OVER w) AND lag(p) OVER w IS NOT NULL AND lead(p) OVER w IS NOT NULL
        THEN (lag(p) OVER w + p + lead(p) OVER w) / 3 ELSE p END, 6) AS p
    FROM (SELECT *, coalesce(lag(zone) OVER w <> zone, false) AS ch FROM fx_zones WINDOW w AS (PARTITION BY curve_id ORDER BY i)) WINDOW w AS (PARTITION BY curve_id ORDER BY i)""")
def _(t):
    return C.average_zone_borders(zoned(t)).select("curve_id", "i", r("p").alias("p"))


@query("win18_boundary_models", f"""
    WITH u AS (SELECT *, greatest(p, 1e-15) AS ps, -{_KT} * ln(greatest(p, 1e-15)) AS u FROM fx_curves),
    f AS (SELECT *, -({_grad('u')}) AS f FROM u {_WC}),
    e AS (SELECT curve_id, max(i) AS n, min(i) FILTER (WHERE ps >= 0.004::DOUBLE) AS li, max(i) FILTER (WHERE ps >= 0.004::DOUBLE) AS ri,
                 min(i) FILTER (WHERE p > 1e-10) AS l0, max(i) FILTER (WHERE p > 1e-10) AS r0 FROM f GROUP BY 1),
    j AS (SELECT f.*, e.*, a.x AS xl, a.u AS ul, CASE WHEN li > 0 THEN a.f ELSE 0 END AS fl, b.x AS xr, b.u AS ur, CASE WHEN ri < e.n THEN b.f ELSE 0 END AS fr, c.x AS x0, d.x AS x1
      FROM (SELECT curve_id, i, x, p, ps FROM f) f JOIN (SELECT curve_id AS cid, * EXCLUDE (curve_id) FROM e) e ON e.cid = f.curve_id JOIN f a ON a.curve_id = cid AND a.i = li JOIN f b ON b.curve_id = cid AND b.i = ri
      JOIN f c ON c.curve_id = cid AND c.i = l0 JOIN f d ON d.curve_id = cid AND d.i = r0)
    SELECT curve_id, i, round(CASE WHEN i NOT BETWEEN l0 AND r0 THEN 0
        WHEN i < li THEN exp(-((500 - fl) / (xl - x0) * (xl - x) * (xl - x) * 0.5::DOUBLE + fl * (xl - x) + ul) / {_KT})
        WHEN i > ri THEN exp(-((fr + 500) / (x1 - xr) * (x - xr) * (x - xr) * 0.5::DOUBLE - fr * (x - xr) + ur) / {_KT}) ELSE ps END, 9) AS p
    FROM j""")
def _(t):
    walled = C.harmonic_boundaries(t.curves.withColumn("ps", F.col("p")), threshold=0.004)
    return walled.select("curve_id", "i", r("p_wall", 9).alias("p"))


@query("st3_boltzmann_inversion", f"""
    WITH k AS (SELECT *, CASE curve_id % 4 WHEN 0 THEN 'bond' WHEN 1 THEN 'angle' WHEN 2 THEN 'dihedral' ELSE 'pair' END AS kind FROM fx_curves),
    q AS (SELECT *, CASE kind WHEN 'bond' THEN p / (4 * pi() * x * x * 2 + 1e-9) WHEN 'angle' THEN p / (sin(radians(x)) + 1e-9) ELSE p END AS q FROM k),
    u AS (SELECT *, CASE WHEN q > 0 THEN -{_KT} * ln(q) END AS u FROM q),
    m AS (SELECT *, CASE WHEN kind = 'pair' THEN u ELSE u - min(u) OVER (PARTITION BY curve_id) END AS v FROM u)
    SELECT curve_id, i, kind, round(coalesce(v, (lag(v) OVER w + lead(v) OVER w) / 2), 6) AS u FROM m {_WC}""")
def _(t):
    return inverted(t).select("curve_id", "i", "kind", r("u").alias("u"))


def with_kind(t):
    m = F.col("curve_id") % 4
    return t.curves.withColumn("kind", F.when(m == 0, "bond").when(m == 1, "angle").when(m == 2, "dihedral").otherwise("pair"))


def inverted(t):
    return C.boltzmann_energy(with_kind(t))


@query("st4_extrapolation", """
    WITH h AS (SELECT table_id, i, x, CASE WHEN i BETWEEN 10 + table_id % 7 AND 180 - table_id % 5 THEN u END AS u FROM fx_potentials),
    e AS (SELECT *, 10 + table_id % 7 AS a, 180 - table_id % 5 AS b FROM h),
    f AS (SELECT table_id, regr_slope(u, x) FILTER (WHERE i BETWEEN a AND a + 4) AS sl, regr_intercept(u, x) FILTER (WHERE i BETWEEN a AND a + 4) AS cl,
                 regr_slope(u, x) FILTER (WHERE i BETWEEN b - 4 AND b) AS sr, regr_intercept(u, x) FILTER (WHERE i BETWEEN b - 4 AND b) AS cr FROM e GROUP BY 1)
    SELECT table_id, i, round(CASE WHEN i < a THEN sl * x + cl WHEN i > b THEN sr * x + cr ELSE u END, 6) AS u FROM e JOIN f USING (table_id)""")
def _(t):
    inside = F.col("i").between(F.lit(10) + F.col("table_id") % 7, F.lit(180) - F.col("table_id") % 5)
    cut = t.potentials.withColumn("u", F.when(inside, F.col("u")))
    return C.extrapolate_ends(cut, 5, "linear", ("table_id",)).select("table_id", "i", r("u").alias("u"))


@query("ag29_force_consistency", f"""
    WITH u AS (SELECT *, -{_KT} * ln(greatest(p, 1e-15)) AS u FROM fx_curves), f AS (SELECT *, -({_grad('u')}) AS f FROM u {_WC}),
    g AS (SELECT *, {_grad('f')} AS g FROM f {_WC}), d AS (SELECT *, {_grad('g')} AS d, max(i) OVER (PARTITION BY curve_id) AS nn FROM g {_WC})
    SELECT curve_id, count(*) FILTER (WHERE abs(d) > 0.05::DOUBLE) AS n_bad, count(*) AS n_checked, round(count(*) FILTER (WHERE abs(d) > 0.05::DOUBLE) / count(*), 6) AS rate
    FROM d JOIN fx_range USING (curve_id) WHERE i >= greatest(1, i_start) AND i < least(nn, i_end + 1) GROUP BY 1""")
def _(t):
    span = C.with_valid_range(counts_as_p(t)).select("curve_id", "i", "i_start", "i_end")
    c = t.curves.select("curve_id", "i", "x", "p").join(span, ["curve_id", "i"])
    return _round(C.force_consistency(c, threshold=0.05), "rate")


def _smoothed(t):
    c = C.with_valid_range(counts_as_p(t))
    arrays = C.to_arrays(c).withColumn("sm", C.gaussian_smooth("ps", 2.0))
    long = C.from_arrays(arrays, ["ps", "sm"]).select("curve_id", "i", "x", F.col("ps").alias("p"), F.col("sm").alias("ps"))
    return long.join(c.select("curve_id", "i", "i_start", "i_end"), ["curve_id", "i"])


def _d2f(table, v, name):
    return f"""(SELECT curve_id, i, {_grad('g')} AS {name} FROM (SELECT *, {_grad('f')} AS g FROM (SELECT *, -({_grad('u')}) AS f FROM
        (SELECT curve_id, i, x, -{_KT} * ln(greatest({v}, 1e-15)) AS u FROM {table}) {_WC}) {_WC}) {_WC})"""


@query("ag28_smoothing_quality", f"""
    WITH s AS ({_gauss_sql(2.0)}),
    ro AS (SELECT curve_id, 2 * sum(a.d * a.d) AS rr, 2 * sum(b.d * b.d) AS rs FROM {_d2f('fx_cn', 'p', 'd')} a JOIN {_d2f('s', 'p', 'd')} b USING (curve_id, i)
      JOIN fx_range USING (curve_id) WHERE i BETWEEN i_start AND i_end GROUP BY 1),
    sp AS (SELECT curve_id, x, p AS height, row_number() OVER (PARTITION BY curve_id ORDER BY i) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY p DESC, i DESC) AS q FROM (SELECT *, lead(g) OVER w AS g1 FROM
        (SELECT *, {_grad('p')} AS g, max(p) OVER (PARTITION BY curve_id) AS top FROM s {_WC}) {_WC}) WHERE g > 0 AND g1 <= 0 AND p >= 0.01::DOUBLE * top) WHERE q <= 6),
    er AS (SELECT curve_id, avg(d) AS pe, avg(e) AS he, count(d) AS m FROM (SELECT r.curve_id, r.rank, min(abs(p.x - r.x)) AS d,
        max(CASE WHEN p.rank = r.rank THEN abs(p.height - r.height) / r.height END) AS e FROM fx_peaks r LEFT JOIN sp p ON p.curve_id = r.curve_id GROUP BY 1, 2) GROUP BY 1)
    SELECT curve_id, round(rr, 2) AS rough_raw, round(rs, 6) AS rough_smooth, round(1 / (1 + pe / 2), 6) AS score_position, round(1 / (1 + coalesce(he, 0)), 6) AS score_height,
           round(rr / (rr + rs), 6) AS score_force, round((rr - rs) / rr, 6) AS reduction,
           round(0.5::DOUBLE / (1 + pe / 2) + 0.35::DOUBLE * rr / (rr + rs) + 0.15::DOUBLE / (1 + coalesce(he, 0)), 6) AS score
    FROM ro JOIN er USING (curve_id)""")
def _(t):
    q = _round(C.smoothing_quality(_smoothed(t)), "rough_raw", digits=2)
    return _round(q, "rough_smooth", "score_position", "score_height", "score_force", "reduction", "score")


@query("jn26_peak_matching")
def _(t):
    c = _smoothed(t)
    return C.match_peaks(C.detect_peaks(c, "p"), C.detect_peaks(c, "ps"), 10.0)


@query("st10_smoothing_sweep")
def _(t):
    return C.sweep_smoothing(t.curves.select("curve_id", "i", "x", "p"))


@query("st11_distribution_smoothing")
def _(t):
    c = cut_lineage(t.curves.select("curve_id", "i", "x", "p"))
    out = None
    for n, kind in enumerate(("bond", "angle", "dihedral", "rdf")):
        part = C.smooth_distributions(c.where(f"curve_id % 4 = {n}"), kind).select("curve_id", F.lit(kind).alias("kind"), "i", "x", "p", "p_smooth")
        out = part if out is None else out.unionByName(part)
    return out
