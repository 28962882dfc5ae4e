"""Closed-form fits of tabulated potentials."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import col
from ..session import cut_lineage, shuffled
from .histograms import goodness_of_fit

SOLVE_POINTS = 1 << 16


def lj_energy(x, sigma, epsilon) -> Column:
    s6 = F.pow(col(sigma) / col(x), F.lit(6.0))
    return F.lit(4.0) * col(epsilon) * (s6 * s6 - s6)


def evaluate_model(form, x, k=None, x0=None, e0=None, sigma=None, epsilon=None) -> Column:
    """Energy of a fitted form at x; angle forms take degrees and work in radians."""
    f, v = col(form), col(x)
    th, th0 = F.radians(v), F.radians(col(x0))
    bond = col(k) * (v - col(x0)) * (v - col(x0)) + col(e0)
    cosine = col(k) * (F.lit(1.0) - F.cos(th - th0)) + col(e0)
    harmonic = col(k) * (th - th0) * (th - th0) + col(e0)
    return (
        F.when(f == "lj", lj_energy(v, sigma, epsilon))
        .when(f == "bond", bond)
        .when(f == "angle_cos", cosine)
        .when(f == "angle_harmonic", harmonic)
    )


# --- least squares as aggregates ---------------------------------------------


def solve3(m, t) -> list[Column]:
    """Solution of a symmetric 3 x 3 system given as columns m[i][j] and t[i], by Cramer's rule."""

    def det(a):
        return (
            a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
            - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
            + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
        )

    base = det(m)
    out = []
    for k in range(3):
        swapped = [[t[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
        out.append(F.when(base != 0, det(swapped) / base))
    return out


def linear_fit3(rows: DataFrame, keys: list[str], basis: list[Column], y: Column) -> DataFrame:
    """Coefficients c0..c2 of y on three basis columns per key."""
    named = rows.select(*keys, *[b.cast("double").alias(f"_b{k}") for k, b in enumerate(basis)], y.alias("_y"))
    sums = named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_fit"),
        *[F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")).alias(f"_m{i}{j}") for i in range(3) for j in range(i, 3)],
        *[F.sum(F.col(f"_b{i}") * F.col("_y")).alias(f"_t{i}") for i in range(3)],
    )
    m = [[F.col(f"_m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    sol = solve3(m, [F.col(f"_t{i}") for i in range(3)])
    return sums.select(*keys, "n_fit", *[s.alias(f"c{k}") for k, s in enumerate(sol)])


def well_region(tables: DataFrame, u_cut: float, keys=("table_id",)) -> DataFrame:
    """Points at most ``u_cut`` above the minimum."""
    low = F.min("u").over(Window.partitionBy(*keys))
    return tables.where("u IS NOT NULL").withColumn("_low", low).where(F.col("u") - F.col("_low") <= u_cut).drop("_low")


def fit_quadratic(rows: DataFrame, keys: list[str], x: Column, names=("k", "r0", "e0")) -> DataFrame:
    """k (x - r0)^2 + e0, linear in (1, t, t^2) around the mean of x; fewer than five points give nulls."""
    w = Window.partitionBy(*keys)
    centred = rows.withColumn("_x", x).withColumn("_c", F.avg("_x").over(w)).withColumn("_t", F.col("_x") - F.col("_c"))
    centre = centred.groupBy(*keys).agg(F.min("_c").alias("_c"))
    fit = linear_fit3(centred, keys, [F.lit(1.0), F.col("_t"), F.col("_t") * F.col("_t")], F.col("u")).join(centre, keys)
    ok = (F.col("n_fit") >= 5) & (F.col("c2") > 0)
    return fit.select(
        *keys, "n_fit", F.when(ok, F.col("c2")).alias(names[0]),
        F.when(ok, F.col("_c") - F.col("c1") / (F.col("c2") * 2)).alias(names[1]),
        F.when(ok, F.col("c0") - F.col("c1") * F.col("c1") / (F.col("c2") * 4)).alias(names[2]),
    )


def fit_bond(tables: DataFrame, u_cut: float = 10.0, keys=("table_id",)) -> DataFrame:
    k = list(keys)
    rows = well_region(tables, u_cut, keys)
    fit = fit_quadratic(rows, k, F.col("x"))
    d = F.col("x") - F.col("r0")
    quality = goodness_of_fit(rows.join(fit, k).withColumn("_fit", F.col("k") * d * d + F.col("e0")), k, "u", "_fit")
    return fit.join(quality.drop("n"), k)


def fit_angle(tables: DataFrame, u_cut: float = 10.0, keys=("table_id",), form: str = "auto") -> DataFrame:
    """Cosine or harmonic angle form from x in degrees; ``auto`` leaves the cosine only where its error is over twice as large."""
    k = list(keys)
    rows = well_region(tables, u_cut, keys)
    th = F.radians("x")
    cos = linear_fit3(rows, k, [F.lit(1.0), F.cos(th), F.sin(th)], F.col("u"))
    amp = F.sqrt(F.col("c1") * F.col("c1") + F.col("c2") * F.col("c2"))
    cos = cos.select(*k, "n_fit", amp.alias("k_cos"), F.degrees(F.atan2(-F.col("c2"), -F.col("c1"))).alias("t_cos"), (F.col("c0") - amp).alias("e_cos"))
    har = fit_quadratic(rows, k, th, ("k_har", "t_har", "e_har")).drop("n_fit").withColumn("t_har", F.degrees("t_har"))
    both = rows.join(cos.join(har, k), k)
    fc = evaluate_model(F.lit("angle_cos"), "x", k="k_cos", x0="t_cos", e0="e_cos")
    fh = evaluate_model(F.lit("angle_harmonic"), "x", k="k_har", x0="t_har", e0="e_har")
    qc = goodness_of_fit(both.withColumn("_f", fc), k, "u", "_f").select(*k, F.col("rmse").alias("rmse_cos"), F.col("r2").alias("r2_cos"))
    qh = goodness_of_fit(both.withColumn("_f", fh), k, "u", "_f").select(*k, F.col("rmse").alias("rmse_har"), F.col("r2").alias("r2_har"))
    out = cos.join(har, k).join(qc, k).join(qh, k)
    use_cos = {"cos": F.lit(True), "harmonic": F.lit(False)}.get(
        form, F.col("rmse_har").isNull() | (F.col("rmse_cos") <= F.col("rmse_har") * 2)
    )

    def pick(name):
        return F.when(use_cos, F.col(f"{name}_cos")).otherwise(F.col(f"{name}_har"))

    return out.select(*k, "n_fit", F.when(use_cos, "angle_cos").otherwise("angle_harmonic").alias("form"), pick("k").alias("k"),
                      pick("t").alias("theta0"), pick("e").alias("e0"), pick("rmse").alias("rmse"), pick("r2").alias("r2"))


# --- pair potentials ---------------------------------------------------------


def tail_shift(tables: DataFrame, keys, how: str, share: float = 0.1) -> DataFrame:
    """Column ``e``: energy minus the median or mean of the last tenth (at least five points)."""
    w = Window.partitionBy(*keys)
    out = tables.where("u IS NOT NULL AND x > 0").withColumn("_rn", F.row_number().over(w.orderBy("x"))).withColumn("_cnt", F.count(F.lit(1)).over(w))
    tail = F.col("_rn") > F.col("_cnt") - F.greatest(F.floor(F.col("_cnt") * F.lit(share)), F.lit(5))
    agg = F.percentile(F.when(tail, F.col("u")), F.lit(0.5)) if how == "median" else F.avg(F.when(tail, F.col("u")))
    base = out.groupBy(*keys).agg(agg.alias("tail"))
    return shuffled(out).join(base, list(keys)).withColumn("e", F.col("u") - F.col("tail")).withColumn("j", F.col("_rn") - 1).drop("_rn", "_cnt")


def curve_features(tables: DataFrame, keys=("table_id",), value: str = "e") -> DataFrame:
    """Minimum, first crossing to below zero, right end of the well and second inflection per table."""
    w = Window.partitionBy(*keys).orderBy("x")
    v, nxt = F.col(value), F.lead(value).over(w)
    out = tables.withColumn("_nv", nxt).withColumn("_nx", F.lead("x").over(w)).withColumn("_dd", nxt - v * 2 + F.lag(value).over(w))
    out = out.withColumn("_pd", F.lag("_dd").over(w))
    cross = (v > 0) & (F.col("_nv") <= 0)
    at = F.col("x") + v / (v - F.col("_nv")) * (F.col("_nx") - F.col("x"))
    flip = F.signum("_dd") != F.signum("_pd")
    base = out.withColumn("_cross", F.when(cross, at)).withColumn("_flip", F.when(flip, F.struct("x", v.alias("v"))))
    low = base.groupBy(*keys).agg(F.min_by("x", F.struct(v.alias("v"), F.col("x"))).alias("r_min"), F.min(v).alias("e_min"), F.max("x").alias("_xmax"))
    joined = shuffled(base).join(low, list(keys))
    # Fixed rule: the well ends one point after the last energy below -max(1e-3, 1 % of the depth).
    depth = F.greatest(F.lit(1e-3), F.abs("e_min") * 0.01)
    return joined.groupBy(*keys, "r_min", "e_min").agg(
        F.min_by("_cross", F.when(F.col("_cross").isNotNull(), F.col("x"))).alias("sigma"),
        F.min_by("_cross", F.when(F.col("_cross").isNotNull() & (F.col("x") < F.col("r_min")), F.col("x"))).alias("sigma_in_wall"),
        F.coalesce(F.max_by(F.coalesce("_nx", "x"), F.when((F.col("x") > F.col("r_min")) & (v < -depth), F.col("x"))), F.max("_xmax")).alias("cutoff"),
        F.get(F.array_sort(F.collect_list("_flip")), F.lit(1)).alias("_second"),
    ).select(*keys, "r_min", "e_min", "sigma", "sigma_in_wall", "cutoff", F.col("_second.x").alias("x_inflection"), F.col("_second.v").alias("v_inflection"))


def _evaluate_lj(rows: DataFrame, params: DataFrame, keys: list[str], y: str = "e") -> DataFrame:
    fitted = rows.join(params, keys).withColumn("_fit", lj_energy("x", "sigma", "epsilon"))
    return goodness_of_fit(fitted, keys, y, "_fit").select(*keys, "rmse", "r2")


def lj_direct(tables: DataFrame, keys=("table_id",), u_eval_max: float = 3.0) -> DataFrame:
    """Sigma from the first zero crossing, epsilon from the depth, tail baseline removed.

    Tables without a well or a crossing get nulls.
    """
    k = list(keys)
    shifted = cut_lineage(tail_shift(tables, keys, "median"))
    f = cut_lineage(curve_features(shifted, keys))
    params = f.select(*k, F.when(F.col("e_min") < 0, F.col("sigma")).alias("sigma"), F.when((F.col("e_min") < 0) & F.col("sigma").isNotNull(), -F.col("e_min")).alias("epsilon"), "r_min", "cutoff")
    seen = shifted.join(params.select(*k, "cutoff"), k).where((F.col("e") <= u_eval_max) | (F.col("x") > F.col("cutoff"))).drop("cutoff")
    return params.join(_evaluate_lj(seen, params.select(*k, "sigma", "epsilon"), k), k, "left")


def lj_well(tables: DataFrame, keys=("table_id",), u_wall: float = 2.0, u_eval_max: float = 3.0) -> DataFrame:
    """First well and the barrier after it; the barrier is the zero of energy.

    Tables without wall, well or barrier drop out of the parameters and get nulls.
    """
    k = list(keys)
    w = Window.partitionBy(*k).orderBy("j")
    rows = cut_lineage(tail_shift(tables, keys, "median")).withColumn("_up", F.lead("e").over(w) - F.col("e")).withColumn("_dn", F.col("e") - F.lag("e").over(w))
    start = rows.groupBy(*k).agg(F.min(F.when(F.col("e") < u_wall, F.col("j"))).alias("_s"))
    rows = rows.join(start, k)
    wells = rows.where("j > _s AND _dn < 0 AND _up > 0").groupBy(*k).agg(F.min(F.struct("j", "x", "e")).alias("_w"))
    barr = rows.join(wells, k).where("j > _w.j AND _dn > 0 AND _up < 0").groupBy(*k).agg(F.min(F.struct("j", "x", "e")).alias("_b"))
    marks = cut_lineage(wells.join(barr, k))
    prev = rows.withColumn("_pe", F.lag("e").over(w)).withColumn("_px", F.lag("x").over(w)).join(marks, k)
    hit = prev.where("j >= _s AND j <= _w.j AND e <= _b.e").groupBy(*k).agg(F.min(F.struct("j", "x", "e", "_px", "_pe")).alias("_h"))
    frac = (F.col("_h._pe") - F.col("_b.e")) / (F.col("_h._pe") - F.col("_h.e"))
    params = cut_lineage(marks.join(hit, k).select(
        *k, (F.col("_h._px") + frac * (F.col("_h.x") - F.col("_h._px"))).alias("sigma"), (F.col("_b.e") - F.col("_w.e")).alias("epsilon"),
        F.col("_w.x").alias("r_min"), F.col("_b.x").alias("cutoff"), F.col("_b.e").alias("_eb"),
    ))
    seen = rows.join(params.select(*k, "cutoff", "_eb"), k).where((F.col("e") <= u_eval_max) & (F.col("x") <= F.col("cutoff")))
    seen = seen.withColumn("e", F.col("e") - F.col("_eb")).drop("cutoff", "_eb")
    fitted = params.drop("_eb").join(_evaluate_lj(seen, params.select(*k, "sigma", "epsilon"), k), k, "left")
    return tables.select(*k).distinct().join(fitted, k, "left")


def lj_search(tables: DataFrame, keys=("table_id",), n_left: int = 6, n_right: int = 12, u_wall: float = 2.0, u_eval_max: float = 3.0) -> DataFrame:
    """Least-squares 12-6 fit over a grid of windows; the best R^2 on a fixed evaluation set wins.

    The energy is linear in r^-12 and r^-6, so a window needs five sums. Windows whose
    solution is not positive drop out.
    """
    k = list(keys)
    rows = tables.where("u IS NOT NULL AND x > 0").withColumn("e", F.col("u"))
    f = cut_lineage(curve_features(rows, keys).select(*k, "r_min", "cutoff"))
    rows = shuffled(rows).join(f, k)
    wall = rows.groupBy(*k).agg(
        F.coalesce(F.max(F.when((F.col("x") < F.col("r_min")) & (F.col("e") >= u_wall), F.col("x"))), F.min("x")).alias("_x0")
    )
    rows = cut_lineage(shuffled(rows).join(wall, k))
    # The work is in the windows, not in the bytes: keep the partition count whatever the size of the tables.
    parts = max(int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions")), tables.sparkSession.sparkContext.defaultParallelism)

    def edge(lo, hi, n, parts):
        return F.when(n == parts, hi).otherwise(lo + (hi - lo) / F.lit(float(parts)) * n.cast("double"))

    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(n_left) for b in range(1, n_right)]))
    grid = shuffled(f).join(wall, k).select(*k, "r_min", "cutoff", "_x0", cells.alias("c")).select(
        *k, "r_min", F.col("c.a").alias("a"), F.col("c.b").alias("b"),
        edge(F.col("_x0"), F.col("r_min"), F.col("c.a"), n_left - 1).alias("left"), edge(F.col("r_min"), F.col("cutoff"), F.col("c.b"), n_right - 1).alias("right"),
    ).where("right > left")
    pts = shuffled(rows.select(*k, "x", "e").repartition(parts, *k)).join(grid, k).where((F.col("x") >= F.col("left")) & (F.col("x") <= F.col("right")))
    q = F.pow(F.col("r_min") / F.col("x"), F.lit(6.0))
    p = q * q
    gk = [*k, "a", "b", "left", "right", "r_min"]
    sums = pts.withColumn("_q", q).withColumn("_p", p).groupBy(*gk).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_p") * F.col("_p")).alias("pp"), F.sum(F.col("_p") * F.col("_q")).alias("pq"),
        F.sum(F.col("_q") * F.col("_q")).alias("qq"), F.sum(F.col("_p") * F.col("e")).alias("pe"), F.sum(F.col("_q") * F.col("e")).alias("qe"),
    ).where("n >= 5")
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    rep = (F.col("pe") * F.col("qq") - F.col("qe") * F.col("pq")) / det
    att = -(F.col("qe") * F.col("pp") - F.col("pe") * F.col("pq")) / det
    fits = cut_lineage(sums.where(det != 0).select(*gk, rep.alias("_A"), att.alias("_B")).where("_A > 0 AND _B > 0").select(
        *k, "a", "b", "left", "right", (F.col("r_min") * F.pow(F.col("_A") / F.col("_B"), F.lit(1.0 / 6.0))).alias("sigma"),
        (F.col("_B") * F.col("_B") / (F.col("_A") * 4)).alias("epsilon"),
    ))
    seen = rows.where((F.col("e") <= u_eval_max) | (F.col("x") > F.col("cutoff"))).select(*k, "x", "e")
    scored = shuffled(seen.repartition(parts, *k)).join(fits, k).withColumn("_fit", lj_energy("x", "sigma", "epsilon"))
    sk = [*k, "a", "b", "left", "right", "sigma", "epsilon"]
    quality = goodness_of_fit(scored, sk, "e", "_fit")
    best = quality.groupBy(*k).agg(F.max_by(F.struct("left", "right", "sigma", "epsilon", "rmse", "r2"), F.struct("r2", -F.col("a"), -F.col("b"))).alias("_best"))
    return shuffled(f.select(*k, "cutoff")).join(best.select(*k, "_best.*"), k, "left")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _curvature(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Second derivatives at the knots of the cubic spline whose third derivative goes on over the second knot from each end.

    A tridiagonal system per curve, solved for many curves of one length at once: as many as ``SOLVE_POINTS`` allows, so that memory
    does not grow with the curves of a batch. Four knots or more.
    """
    out, sizes = [None] * len(xs), xs.map(len).to_numpy()
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        step = max(1, SOLVE_POINTS // max(1, n))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            m = np.zeros((len(own), n))
            if n >= 4:
                _solve(*(np.stack(v.iloc[own].to_list()) for v in (xs, ys)), m)
            for k, one in zip(own, m):
                out[k] = one
    return pd.Series(out)


def _solve(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> None:
    """Fills ``m`` with the second derivatives of the curves in the rows of x and y."""
    n = x.shape[1]
    h = np.diff(x)
    d = np.diff(y) / h
    low, mid, up = h[:, :-1].copy(), 2 * (h[:, :-1] + h[:, 1:]), h[:, 1:].copy()
    right = 6 * np.diff(d)
    a, b = h[:, 0] / h[:, 1], h[:, -1] / h[:, -2]
    mid[:, 0] += h[:, 0] * (1 + a)
    up[:, 0] -= h[:, 0] * a
    mid[:, -1] += h[:, -1] * (1 + b)
    low[:, -1] -= h[:, -1] * b
    for k in range(1, n - 2):
        w = low[:, k] / mid[:, k - 1]
        mid[:, k] -= w * up[:, k - 1]
        right[:, k] -= w * right[:, k - 1]
    m[:, n - 2] = right[:, -1] / mid[:, -1]
    for k in range(n - 4, -1, -1):
        m[:, k + 1] = (right[:, k] - up[:, k] * m[:, k + 2]) / mid[:, k]
    m[:, 0] = (1 + a) * m[:, 1] - a * m[:, 2]
    m[:, -1] = (1 + b) * m[:, -2] - b * m[:, -3]


def spline_intervals(curves: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The cubic spline through each curve, one row per interval: (keys, k, n, x0, x1, y0, y1, m0, m1), m the second derivatives.

    Curves have distinct x and are a grid of some thousand points at most; they come together by key.
    """
    arr = curves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v")))).alias("_p"))
    arr = arr.select(*keys, F.col("_p.x").alias("_x"), F.col("_p.v").alias("_y")).withColumn("_m", _curvature("_x", "_y"))
    rows = arr.select(*keys, F.size("_x").alias("n"), "_x", "_y", "_m", F.explode(F.sequence(F.lit(0), F.size("_x") - 2)).alias("k"))
    at = lambda c, step: F.get(f"_{c}", F.col("k") + step).alias(f"{c}{step}")
    return rows.select(*keys, "k", "n", *[at(c, step) for c in "xym" for step in (0, 1)])


def spline_value(r: Column) -> tuple[Column, Column]:
    """Value and slope of an interval's cubic at ``r``."""
    h = F.col("x1") - F.col("x0")
    a, b = (F.col("x1") - r) / h, (r - F.col("x0")) / h
    value = a * F.col("y0") + b * F.col("y1") + ((a * a * a - a) * F.col("m0") + (b * b * b - b) * F.col("m1")) * h * h / 6.0
    slope = (F.col("y1") - F.col("y0")) / h + ((b * b * 3.0 - 1.0) * F.col("m1") - (a * a * 3.0 - 1.0) * F.col("m0")) * h / 6.0
    return value, slope


def second_inflection(shifted: DataFrame, key: str) -> DataFrame:
    """(key, v_inflection): the spline's value where its second derivative changes sign for the second time."""
    flips = spline_intervals(shifted, [key], "e").where("m0 * m1 < 0")
    at = flips.withColumn("_r", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("m0") / (F.col("m0") - F.col("m1")))
    found = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", spline_value(F.col("_r"))[0].alias("v")))).alias("_f"))
    return found.select(key, F.get("_f", F.lit(1))["v"].alias("v_inflection"))


def mix_tables(tables: DataFrame, pairs: DataFrame, mode: str = "geometric", force_negative: bool = True) -> DataFrame:
    """Cross potentials for the listed (a, b) table pairs, one row per grid point.

    Both tables are shifted by their tail and put in reduced variables; a table
    without a well is shifted once more by its second inflection. Values and slopes come from cubic splines, at the
    points of a grid one point longer than the longer table; the force is the derivative of the mixed energy,
    also where the signs of the tables differ. Every grid point meets its interval of each table by its number; no curve is
    gathered for a pair.
    """
    key = ("table_id",)
    shifted = cut_lineage(tail_shift(tables, key, "mean"))
    f = curve_features(shifted, key).join(second_inflection(shifted, "table_id").withColumnRenamed("v_inflection", "_v2"), "table_id", "left")
    lifted = shifted.join(f.select("table_id", "_v2", (F.col("sigma_in_wall").isNull() | (F.col("e_min") >= 0)).alias("_bad")), "table_id")
    lifted = lifted.withColumn("e2", F.when(F.col("_bad"), F.col("e") - F.col("_v2")).otherwise(F.col("e")))
    f2 = curve_features(lifted, key, "e2").where("sigma_in_wall IS NOT NULL AND e_min < 0")
    scale = f2.select("table_id", F.col("sigma_in_wall").alias("sigma"), (-F.col("e_min")).alias("eps"))
    reduced = lifted.join(scale, "table_id").select("table_id", "sigma", "eps", (F.col("x") / F.col("sigma")).alias("x"), (F.col("e") / F.col("eps")).alias("v"))
    parts = cut_lineage(spline_intervals(reduced, ["table_id", "sigma", "eps"], "v"))
    spans = parts.groupBy("table_id", "sigma", "eps").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.max("n").alias("n"))

    def side(s):
        return spans.select(F.col("table_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("sigma", "eps", "lo", "hi", "n")])

    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("_lo", F.greatest("lo_a", "lo_b")).withColumn("_n", F.greatest("n_a", "n_b"))
    both = both.withColumn("_st", (F.least("hi_a", "hi_b") - F.col("_lo")) / F.col("_n")).where("_st > 0")
    both = cut_lineage(both.select("a", "b", "sigma_a", "sigma_b", "eps_a", "eps_b", "_lo", "_st", "_n"))

    def on_grid(s):
        mine = both.select("a", "b", "_lo", "_st", "_n", F.col(s).alias("table_id")).join(parts.drop("sigma", "eps"), "table_id")
        near = lambda c, f, d: f((F.col(c) - F.col("_lo")) / F.col("_st")).cast("bigint") + d
        ends = F.greatest(near("x0", F.floor, -1), F.lit(0)), F.least(near("x1", F.ceil, 1), F.col("_n").cast("bigint"))
        cells = mine.withColumn("_i0", ends[0]).withColumn("_i1", ends[1]).where("_i0 <= _i1").withColumn("i", F.explode(F.sequence("_i0", "_i1")))
        r = F.col("_lo") + F.col("_st") * F.col("i")
        inside = ((r >= F.col("x0")) | (F.col("k") == 0)) & ((r < F.col("x1")) | (F.col("k") == F.col("n") - 2))
        value, slope = spline_value(r)
        return cells.where(inside).select("a", "b", "i", r.alias("_r"), value.alias(f"v{s}"), slope.alias(f"d{s}"))

    rows = on_grid("a").join(on_grid("b").drop("_r"), ["a", "b", "i"]).join(both.select("a", "b", "sigma_a", "sigma_b", "eps_a", "eps_b"), ["a", "b"])
    va, vb, da, db = (F.col(c) for c in ("va", "vb", "da", "db"))
    sigma, eps = (F.col("sigma_a") + F.col("sigma_b")) / 2, F.sqrt(F.col("eps_a") * F.col("eps_b"))
    if mode == "arithmetic":
        energy, slope = (F.col("eps_a") * va + F.col("eps_b") * vb) / 2, (F.col("eps_a") * da + F.col("eps_b") * db) / 2
    else:
        size = F.sqrt(F.abs(va * vb))
        sign = F.when(F.signum(va) != F.signum(vb), -1.0).otherwise(F.signum(va)) if force_negative else F.signum(va)
        energy = sign * size * eps
        slope = F.when(size > 0, sign * F.signum(va * vb) * (da * vb + va * db) / (size * 2.0)).otherwise(0.0) * eps
    return rows.select(
        "a", "b", "i", (F.col("_r") * sigma).alias("x"), energy.alias("u"), sigma.alias("sigma_mix"), eps.alias("eps_mix"), "sigma_a", "sigma_b", "eps_a", "eps_b",
        (-slope / sigma).alias("f"),
    )


def mixing_checks(mixed: DataFrame) -> DataFrame:
    """Crossing between both sigmas, depth between both epsilons, wall falling strictly."""
    key = ("a", "b")
    mixed = cut_lineage(mixed)
    f = curve_features(mixed.withColumn("e", F.col("u")), key).select("a", "b", F.col("sigma").alias("zero_crossing"), "e_min")
    fall = F.lead("u").over(Window.partitionBy(*key).orderBy("i")) - F.col("u")
    wall = (F.col("x") < F.col("sigma_mix")) & (F.lead("x").over(Window.partitionBy(*key).orderBy("i")) < F.col("sigma_mix"))
    scales = mixed.withColumn("_rise", wall & (fall >= 0)).groupBy("a", "b").agg(
        *[F.max(c).alias(c) for c in ("sigma_mix", "eps_mix", "sigma_a", "sigma_b", "eps_a", "eps_b")],
        F.count_if("_rise").alias("_rises"), F.count_if(F.col("x") < F.col("sigma_mix")).alias("_wall"),
    )
    out = f.join(scales, ["a", "b"])

    def between(v, p, q):
        return F.coalesce(v.between(F.least(p, q), F.greatest(p, q)), F.lit(False))

    return out.select(
        "a", "b", "sigma_mix", "eps_mix", "zero_crossing",
        between(F.col("zero_crossing"), "sigma_a", "sigma_b").alias("between_sigma"),
        between(F.abs("e_min"), "eps_a", "eps_b").alias("eps_between"),
        ((F.col("_wall") > 2) & (F.col("_rises") == 0)).alias("repulsive_monotonic"),
    )
