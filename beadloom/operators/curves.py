"""Curve processing on long tables (curve_id, i, x, p): one job for all curves.

A curve is a grid of some hundred points, so windows over ``curve_id`` and
arrays per curve are bounded; the number of curves is what grows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import BOLTZMANN
from ..session import cut_lineage, shuffled, spread

KEYS = ("curve_id",)
# Defaults of the smoothing and quality rules.
ZERO_THRESHOLD = 1e-4
CDF_SHARE = 0.99
MAX_PEAKS = 6
MIN_HEIGHT = 0.01
BOUNDARY_RATIO = 0.8
BOUNDARY_DECAY = 2.0
BOUNDARY_EPSILON = 0.001
WEIGHTS = {"position": 0.5, "force": 0.35, "height": 0.15}
TEMPERATURE = 400.0
KT = BOLTZMANN["kcal/mol"] * TEMPERATURE


def _w(keys):
    return Window.partitionBy(*keys).orderBy("i")


def _all(keys):
    return Window.partitionBy(*keys)


def gradient(value: str, keys=KEYS, x: str = "x") -> Column:
    """Second-order difference on any grid, one-sided at both ends."""
    w = _w(keys)
    v, f0, f1 = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    inner = (hs * hs * f1 + (hd * hd - hs * hs) * v - hd * hd * f0) / (hs * hd * (hd + hs))
    return F.when(hs.isNull(), (f1 - v) / hd).when(hd.isNull(), (v - f0) / hs).otherwise(inner)


def with_force(curves: DataFrame, energy: str = "u", keys=KEYS) -> DataFrame:
    """f = -dU/dx and its second derivative d2f."""
    out = curves.withColumn("f", -gradient(energy, keys))
    out = out.withColumn("_g", gradient("f", keys))
    return out.withColumn("d2f", gradient("_g", keys)).drop("_g")


def fill_isolated_gaps(curves: DataFrame, value: str = "u", keys=KEYS) -> DataFrame:
    """A null between two values becomes their mean; null stands for an unsampled point."""
    w = _w(keys)
    mean = (F.lag(value).over(w) + F.lead(value).over(w)) / 2.0
    return curves.withColumn(value, F.coalesce(F.col(value), mean))


def boltzmann_energy(curves: DataFrame, keys=KEYS, kt: float = KT, jacobian: bool = True) -> DataFrame:
    """U = -kT ln(P / jacobian) per ``kind``; the lowest point is zero except for pairs; gaps filled."""
    w = _w(keys)
    step = F.max(F.when(F.col("i") == 1, F.col("x"))).over(_all(keys)) - F.min("x").over(_all(keys))
    if jacobian:
        shell = F.lit(4 * math.pi) * F.col("x") * F.col("x") * step + 1e-9
        prob = F.when(F.col("kind") == "bond", F.col("p") / shell).when(
            F.col("kind") == "angle", F.col("p") / (F.sin(F.radians("x")) + 1e-9)
        ).otherwise(F.col("p"))
    else:
        prob = F.col("p")
    out = curves.withColumn("_q", prob).withColumn("u", F.when(F.col("_q") > 0, F.lit(-kt) * F.log("_q")))
    low = F.min("u").over(_all(keys))
    out = out.withColumn("_low", low)
    out = out.withColumn("u", F.when(F.col("kind") == "pair", F.col("u")).otherwise(F.col("u") - F.col("_low"))).drop("_q", "_low")
    del w
    return fill_isolated_gaps(out, "u", keys)


def extrapolate_ends(curves: DataFrame, k: int = 5, method: str = "linear", keys=KEYS) -> DataFrame:
    """Unsampled ends from a straight line, or an exponential, through the k outermost points."""
    known = F.col("u").isNotNull()
    w = _all(keys)
    out = curves.withColumn("_first", F.min(F.when(known, F.col("i"))).over(w)).withColumn("_last", F.max(F.when(known, F.col("i"))).over(w))
    out = out.withColumn("_low", F.min("u").over(w))
    y = F.col("u") if method == "linear" else F.log(F.col("u") - F.col("_low") + 1e-9)
    left = known & (F.col("i") < F.col("_first") + k)
    right = known & (F.col("i") > F.col("_last") - k)
    fits = out.groupBy(*keys).agg(*[
        agg(F.when(side, y), F.when(side, F.col("x"))).alias(f"_{name}_{end}")
        for end, side in (("l", left), ("r", right)) for name, agg in (("s", F.regr_slope), ("c", F.regr_intercept))
    ])
    out = out.join(fits, list(keys))

    def line(end):
        v = F.col(f"_s_{end}") * F.col("x") + F.col(f"_c_{end}")
        return v if method == "linear" else F.exp(v) + F.col("_low") - 1e-9

    u = F.when(F.col("i") < F.col("_first"), line("l")).when(F.col("i") > F.col("_last"), line("r")).otherwise(F.col("u"))
    return out.withColumn("u", u).select(*curves.columns)


# --- preparation -------------------------------------------------------------


def with_valid_range(curves: DataFrame, share: float = CDF_SHARE, keys=KEYS) -> DataFrame:
    """i_start and i_end: first indices whose cumulative share reaches both tails."""
    tail = (1.0 - share) / 2.0
    w = _all(keys)
    out = curves.withColumn("_c", F.sum("p").over(_w(keys).rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_t", F.max("_c").over(w)).withColumn("_n", F.max("i").over(w))
    c = F.col("_c") / F.col("_t")
    filled = F.col("_t") > 0
    start = F.min(F.when(filled & (c >= tail), F.col("i"))).over(w)
    end = F.min(F.when(filled & (c >= 1.0 - tail), F.col("i"))).over(w)
    out = out.withColumn("i_start", F.coalesce(start, F.lit(0).cast("bigint"))).withColumn("i_end", F.coalesce(end, F.col("_n")))
    return out.withColumn("i_end", F.greatest("i_start", "i_end")).drop("_c", "_t", "_n")


def interpolate_zeros(curves: DataFrame, threshold: float = ZERO_THRESHOLD, keys=KEYS) -> DataFrame:
    """Points below the threshold between two good ones of the valid range lie on their chord."""
    inside = F.col("i").between(F.col("i_start"), F.col("i_end"))
    good = inside & (F.col("p") >= threshold)
    left = _w(keys).rowsBetween(Window.unboundedPreceding, -1)
    right = _w(keys).rowsBetween(1, Window.unboundedFollowing)
    point = F.when(good, F.struct("x", "p"))
    out = curves.withColumn("_l", F.last(point, ignorenulls=True).over(left)).withColumn("_r", F.first(point, ignorenulls=True).over(right))
    t = (F.col("x") - F.col("_l.x")) / (F.col("_r.x") - F.col("_l.x"))
    chord = F.col("_l.p") + t * (F.col("_r.p") - F.col("_l.p"))
    fill = inside & (F.col("p") < threshold) & F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return out.withColumn("p", F.when(fill, chord).otherwise(F.col("p"))).drop("_l", "_r")


# --- peaks -------------------------------------------------------------------


def detect_peaks(curves: DataFrame, value: str = "p", keys=KEYS, max_peaks: int = MAX_PEAKS, min_height: float = MIN_HEIGHT) -> DataFrame:
    """(keys, i, x, height, rank): slope turns from rising to not rising; the highest few, ranked in x."""
    out = curves.withColumn("_g", gradient(value, keys)).withColumn("_top", F.max(value).over(_all(keys)))
    out = out.withColumn("_next", F.lead("_g").over(_w(keys)))
    hits = out.where((F.col("_g") > 0) & (F.col("_next") <= 0) & (F.col(value) >= F.lit(min_height) * F.col("_top")))
    order = Window.partitionBy(*keys).orderBy(F.desc(value), F.desc("i"))
    top = hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_peaks)
    return top.select(*keys, "i", "x", F.col(value).alias("height"), F.row_number().over(_w(keys)).alias("rank"))


def prominent_peaks(curves: DataFrame, share: float = 0.1, keys=KEYS) -> DataFrame:
    """Local maxima, flat tops counted once, whose prominence reaches a share of the maximum."""
    w = _w(keys)
    runs = curves.withColumn("_new", F.when(F.col("p") == F.lag("p").over(w), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = runs.groupBy(*keys, "_run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("p").alias("h"))
    rw = Window.partitionBy(*keys).orderBy("_run")
    flat = flat.withColumn("_pl", F.lag("h").over(rw)).withColumn("_pr", F.lead("h").over(rw)).withColumn("_top", F.max("h").over(_all(keys)))
    tops = flat.where("h > _pl AND h > _pr").select(*keys, F.floor((F.col("a") + F.col("b")) / 2).alias("pk"), "h", "_top")
    pts = tops.join(curves.select(*keys, "i", "p"), list(keys))
    higher = F.col("p") > F.col("h")
    walls = pts.groupBy(*keys, "pk", "h", "_top").agg(
        F.max(F.when(higher & (F.col("i") < F.col("pk")), F.col("i"))).alias("_wl"), F.min(F.when(higher & (F.col("i") > F.col("pk")), F.col("i"))).alias("_wr")
    )
    spans = walls.join(curves.select(*keys, "i", "p"), list(keys))
    lside = (F.col("i") <= F.col("pk")) & (F.col("i") > F.coalesce("_wl", F.lit(-1)))
    rside = (F.col("i") >= F.col("pk")) & (F.col("_wr").isNull() | (F.col("i") < F.col("_wr")))
    out = spans.groupBy(*keys, "pk", "h", "_top").agg(F.min(F.when(lside, F.col("p"))).alias("_ml"), F.min(F.when(rside, F.col("p"))).alias("_mr"))
    out = out.withColumn("prominence", F.col("h") - F.greatest("_ml", "_mr"))
    return out.where(F.col("prominence") >= F.lit(share) * F.col("_top")).select(*keys, F.col("pk").alias("i"), F.col("h").alias("height"), "prominence")


def peak_width(curves: DataFrame, peaks: DataFrame, keys=KEYS) -> DataFrame:
    """Mean full width at half height per curve; 5 % of the range without a usable peak."""
    k = list(keys)
    pts = peaks.select(*k, F.col("i").alias("pk"), F.col("x").alias("_px"), "height").join(curves.select(*k, "i", "x", "p"), k)
    low = F.col("p") < F.col("height") / 2
    ends = pts.groupBy(*k, "pk", "_px").agg(
        F.max_by("x", F.when(low & (F.col("i") < F.col("pk")), F.col("i"))).alias("_l"),
        F.min_by("x", F.when(low & (F.col("i") > F.col("pk")), F.col("i"))).alias("_r"),
    )
    width = F.coalesce("_r", "_px") - F.coalesce("_l", "_px")
    means = ends.withColumn("_wd", width).where("_wd > 0").groupBy(*k).agg(F.avg("_wd").alias("_m"))
    spans = curves.groupBy(*k).agg((F.max("x") - F.min("x")).alias("_s"))
    return spans.join(means, k, "left").select(*k, F.coalesce("_m", F.col("_s") * 0.05).alias("width"))


def match_peaks(raw: DataFrame, smooth: DataFrame, max_distance: float, keys=KEYS) -> DataFrame:
    """Raw peaks in x order take the nearest free smooth peak within the distance.

    Both lists hold at most six peaks; the greedy choice runs as a fold over them.
    """
    k = list(keys)
    a = raw.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("x", "height"))).alias("_a"))
    b = smooth.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("x", "height"))).alias("_b"))
    peak = "struct<x:double,height:double>"
    none = F.lit(None).cast(peak)
    start = F.struct(F.col("_b").alias("free"), F.array().cast(f"array<struct<raw:{peak},smooth:{peak}>>").alias("done"))

    def step(acc, r):
        near = F.filter(acc["free"], lambda s: F.abs(s["x"] - r["x"]) <= max_distance)
        best = F.array_min(F.transform(near, lambda s: F.struct(F.abs(s["x"] - r["x"]).alias("d"), s["x"].alias("x"), s["height"].alias("height"))))
        pick = F.when(best.isNotNull(), F.struct(best["x"].alias("x"), best["height"].alias("height"))).otherwise(none)
        free = F.filter(acc["free"], lambda s: best.isNull() | (s["x"] != best["x"]))
        return F.struct(free.alias("free"), F.concat(acc["done"], F.array(F.struct(r.alias("raw"), pick.alias("smooth")))).alias("done"))

    joined = a.join(b, k, "left").withColumn("_b", F.coalesce("_b", F.array().cast(f"array<{peak}>")))
    folded = joined.select(*k, F.posexplode(F.aggregate("_a", start, step)["done"]).alias("raw_index", "_m"))
    return folded.select(
        *k, "raw_index", F.col("_m.raw.x").alias("raw_x"), F.col("_m.raw.height").alias("raw_height"),
        F.col("_m.smooth.x").alias("smooth_x"), F.col("_m.smooth.height").alias("smooth_height"),
        F.abs(F.col("_m.smooth.x") - F.col("_m.raw.x")).alias("shift"),
        F.when(F.col("_m.raw.height") > 0, (F.col("_m.smooth.height") - F.col("_m.raw.height")) / F.col("_m.raw.height")).alias("height_change"),
    )


# --- smoothing ---------------------------------------------------------------


def to_arrays(curves: DataFrame, keys=KEYS) -> DataFrame:
    """One row per curve with its grid and values in order."""
    pts = F.array_sort(F.collect_list(F.struct("i", "x", "p")))
    return curves.groupBy(*keys).agg(pts.alias("_pts")).select(*keys, F.col("_pts.x").alias("xs"), F.col("_pts.p").alias("ps"))


def from_arrays(arrays: DataFrame, values: list[str], keys=KEYS) -> DataFrame:
    """Back to (keys, i, x, values...)."""
    zipped = F.arrays_zip("xs", *values)
    rows = arrays.select(*keys, F.posexplode(zipped).alias("i", "_z"))
    return rows.select(*keys, F.col("i").cast("bigint").alias("i"), F.col("_z.xs").alias("x"), *[F.col(f"_z.{v}").alias(v) for v in values])


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [v / total for v in raw]


def _weighted(values: Column, weights: Column, index) -> Column:
    """sum over k of weights[k] * values[index(k)]"""
    last = F.size(weights) - 1
    return F.aggregate(
        F.sequence(F.lit(0), last), F.lit(0.0), lambda acc, k: acc + F.get(weights, k) * F.get(values, index(k))
    )


def gaussian_smooth(values, sigma: float, periodic: bool = False) -> Column:
    """Gaussian filter of an array column, mirrored at the ends or wrapped around."""
    v = F.col(values) if isinstance(values, str) else values
    ws = gaussian_weights(sigma)
    radius = len(ws) // 2
    weights = F.array(*[F.lit(w) for w in ws])
    n = F.size(v)

    def at(i):
        def index(k):
            j = i + k - radius
            if periodic:
                return F.pmod(j, n)
            m = F.pmod(j, n * 2)
            return F.when(m < n, m).otherwise(n * 2 - 1 - m)

        return F.greatest(F.lit(0.0), _weighted(v, weights, index))

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def savgol_matrix(window: int, order: int) -> list[list[float]]:
    """Rows of the polynomial projection: the middle one smooths, the others serve the ends."""
    t = np.arange(window) - (window - 1) / 2.0
    basis = np.vander(t, order + 1, increasing=True)
    return (basis @ np.linalg.pinv(basis)).tolist()


def savgol_smooth(values, window: int, order: int = 3) -> Column:
    """Savitzky-Golay filter of an array column; the ends take the polynomial of the outermost window."""
    v = F.col(values) if isinstance(values, str) else values
    half = window // 2
    matrix = F.array(*[F.array(*[F.lit(c) for c in row]) for row in savgol_matrix(window, order)])
    n = F.size(v)

    def at(i):
        start = F.greatest(F.lit(0), F.least(i - half, n - window))
        return _weighted(v, F.get(matrix, i - start), lambda k: start + k)

    smooth = F.transform(F.sequence(F.lit(0), n - 1), at)
    return F.when(n >= window, smooth).otherwise(v)


def odd_window(window: int, order: int) -> int:
    size = max(order + 2, window)
    return size if size % 2 else size + 1


def select_sigma(curves: DataFrame, sigmas: list[float], target: Column, keys=KEYS) -> DataFrame:
    """Smoothed curves with the first sigma that leaves no more than ``target`` peaks.

    ``target`` is a column of ``curves`` constant per curve. Where no sigma does,
    the one with the fewest peaks is taken.
    """
    k = list(keys)
    arrays = to_arrays(curves, keys).join(curves.groupBy(*k).agg(F.max(target).alias("_target")), k)
    tries = F.array(*[
        F.struct(F.lit(n).alias("order"), F.lit(float(s)).alias("sigma"), gaussian_smooth("ps", s).alias("smooth")) for n, s in enumerate(sigmas)
    ])
    tried = arrays.select(*k, "xs", "_target", F.inline(tries))
    tk = [*k, "order"]
    long = from_arrays(tried.select(*tk, "xs", "smooth"), ["smooth"], tk)
    found = detect_peaks(long, "smooth", tk).groupBy(*tk).agg(F.count(F.lit(1)).alias("n_peaks"))
    scored = tried.join(found, tk, "left").withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)))
    ok = F.col("n_peaks") <= F.col("_target")
    rank = F.struct(F.when(ok, 0).otherwise(1), F.when(ok, F.col("order")).otherwise(F.col("n_peaks")), "order")
    best = scored.groupBy(*k).agg(F.min_by(F.struct("xs", "smooth", "sigma", "n_peaks"), rank).alias("b"))
    return best.select(*k, "b.*")


def select_sigma_by_score(curves: DataFrame, sigmas: list[float], keys=KEYS, periodic: bool = True) -> DataFrame:
    """Smoothed curves with the sigma of the best score: (keys, xs, smooth, sigma, score).

    The score is the share by which smoothing lowers the force roughness over the whole curve, times the squared correlation of raw
    and smoothed values where the raw ones are positive (0.5 for ten such points or fewer), times 1 / (1 + 1000 d) for a
    step d between the two ends. Of equal scores the first sigma wins.
    """
    k = list(keys)
    arrays = cut_lineage(to_arrays(curves, keys))
    tries = F.array(*[
        F.struct(F.lit(n).alias("order"), F.lit(float(s)).alias("sigma"), gaussian_smooth("ps", s, periodic).alias("smooth")) for n, s in enumerate(sigmas)
    ])
    tried = cut_lineage(arrays.select(*k, "xs", "ps", F.inline(tries)))
    tk = [*k, "order"]
    long = from_arrays(tried, ["ps", "smooth"], tk)
    whole = lambda df, ks: df.withColumn("i_start", F.lit(0)).withColumn("i_end", F.max("i").over(_all(ks)))
    rough = _roughness(whole(long, tk), "smooth", "_after", tk).drop("_h")
    raw = _roughness(whole(from_arrays(arrays, ["ps"], k), k), "ps", "_before", k).drop("_h")
    seen = F.col("ps") > 1e-10
    like = long.groupBy(*tk).agg(F.corr(F.when(seen, F.col("ps")), F.when(seen, F.col("smooth"))).alias("_c"), F.count_if(seen).alias("_m"))
    out = tried.join(rough, tk).join(raw, k).join(like, tk)
    alike = F.when((F.col("_m") > 10) & ~F.isnan("_c"), F.col("_c")).otherwise(0.5)
    less = F.when(F.col("_before") > 0, (F.col("_before") - F.col("_after")) / F.col("_before")).otherwise(0.0)
    step = F.abs(F.get("smooth", F.lit(0)) - F.element_at("smooth", -1))
    scored = out.withColumn("score", less * F.coalesce(alike, F.lit(0.5)) * F.coalesce(alike, F.lit(0.5)) / (step * 1000.0 + 1.0))
    best = scored.groupBy(*k).agg(F.max_by(F.struct("xs", "smooth", "sigma", "score"), F.struct("score", -F.col("order"))).alias("b"))
    return best.select(*k, "b.*")


def with_zones(curves: DataFrame, peaks: DataFrame, widths: DataFrame, kind: str, factor: float | Column = 1.0, keys=KEYS) -> DataFrame:
    """Zone per point: 0 left zero, 1 peak, 2 valley, 3 far end of g(r), 4 right zero.

    ``curves`` has i_start and i_end. Peaks are at most six per curve and come as an array.
    """
    k = list(keys)
    w = _all(keys)
    near = peaks.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_pk"))
    out = curves.join(near, k, "left").join(widths, k)
    out = out.withColumn("_x1", F.max("x").over(w)).withColumn("_x0", F.min("x").over(w))
    f = factor if isinstance(factor, Column) else F.lit(factor)
    avg = F.when(F.col("_pk").isNotNull(), F.col("width") * f).otherwise((F.col("_x1") - F.col("_x0")) / 20)
    inside = F.col("i").between(F.col("i_start"), F.col("i_end"))
    is_peak = F.exists("_pk", lambda q: q["i"].between(F.col("i_start"), F.col("i_end")) & (F.abs(F.col("x") - q["x"]) <= avg / 2))
    zone = F.when(inside & F.coalesce(is_peak, F.lit(False)), 1).when(inside, 2).otherwise(0)
    if kind in ("bond", "angle"):
        zone = F.when(F.col("i") > F.col("i_end"), 4).otherwise(zone)
    elif kind == "rdf":
        floor = F.lit(BOUNDARY_RATIO) * F.col("_x1")
        n = F.size("_pk")
        far = F.when(F.col("_pk").isNull(), floor).when(n >= MAX_PEAKS, F.greatest(F.get("_pk", F.lit(MAX_PEAKS - 1))["x"], floor)).otherwise(
            F.greatest(F.get("_pk", n - 1)["x"] + avg, floor)
        )
        turn = F.min(F.when(F.col("x") >= far, F.col("x"))).over(w)
        out = out.withColumn("_turn", F.coalesce(turn, F.col("_x1")))
        zone = F.when(F.col("x") >= F.col("_turn"), 3).otherwise(zone)
    return out.withColumn("zone", zone).drop("_pk", "_x0", "_x1", "_turn", "width")


def average_zone_borders(curves: DataFrame, value: str = "p", keys=KEYS) -> DataFrame:
    """Three-point mean on the points next to a change of zone; the two ends stay."""
    w = _w(keys)
    out = curves.withColumn("_ch", F.when(F.lag("zone").over(w).isNull(), False).otherwise(F.lag("zone").over(w) != F.col("zone")))
    near = F.col("_ch") | F.lag("_ch", 1, False).over(w) | F.lead("_ch", 1, False).over(w)
    mean = (F.lag(value).over(w) + F.col(value) + F.lead(value).over(w)) / 3.0
    return out.withColumn(value, F.when(near, F.coalesce(mean, F.col(value))).otherwise(F.col(value))).drop("_ch")


def rdf_far_end(curves: DataFrame, value: str = "p", keys=KEYS, decay: float = BOUNDARY_DECAY, epsilon: float = BOUNDARY_EPSILON) -> DataFrame:
    """Zone 3 decays to just below one from its first point on."""
    first = F.min(F.when(F.col("zone") == 3, F.col("x"))).over(_all(keys))
    out = curves.withColumn("_t", first)
    weight = F.exp(-(F.col("x") - F.col("_t")) / decay)
    v = F.col(value) * weight + (1.0 - epsilon) * (F.lit(1.0) - weight)
    return out.withColumn(value, F.when(F.col("zone") == 3, v).otherwise(F.col(value))).drop("_t")


def harmonic_boundaries(curves: DataFrame, keys=KEYS, threshold: float = 0.0015, f_max: float = 500.0, kt: float = KT, right: bool = True,
                        smooth: str = "ps", raw: str = "p") -> DataFrame:
    """Tails below the threshold replaced by the density of a harmonic wall.

    ``smooth`` is the smoothed density, ``raw`` tells where data exist. The wall
    starts with the force at the outermost core point and reaches ``f_max`` at the
    end of the data. Outside the data the density is zero.
    """
    w = _all(keys)
    out = curves.withColumn("_ps", F.greatest(F.col(smooth), F.lit(1e-15))).withColumn("_u", F.lit(-kt) * F.log("_ps"))
    out = out.withColumn("_f", -gradient("_u", keys))
    core = F.col("_ps") >= threshold
    has = F.col(raw) > 1e-10
    point = F.struct("i", "x", "_u", "_f")
    out = out.withColumn("_lc", F.min(F.when(core, point)).over(w)).withColumn("_rc", F.max(F.when(core, point)).over(w))
    out = out.withColumn("_l0", F.min(F.when(has, F.struct("i", "x"))).over(w)).withColumn("_r0", F.max(F.when(has, F.struct("i", "x"))).over(w))
    out = out.withColumn("_n", F.max("i").over(w))
    fl = F.when(F.col("_lc.i") > 0, F.col("_lc._f")).otherwise(0.0)
    fr = F.when(F.col("_rc.i") < F.col("_n"), F.col("_rc._f")).otherwise(0.0)
    dl, dr = F.col("_lc.x") - F.col("x"), F.col("x") - F.col("_rc.x")
    kl = (F.lit(f_max) - fl) / (F.col("_lc.x") - F.col("_l0.x"))
    kr = (fr + f_max) / (F.col("_r0.x") - F.col("_rc.x"))
    ul = kl * dl * dl * 0.5 + fl * dl + F.col("_lc._u")
    ur = kr * dr * dr * 0.5 - fr * dr + F.col("_rc._u")
    inside = F.col("i").between(F.col("_l0.i"), F.col("_r0.i"))
    value = F.when(F.col("_l0").isNull(), F.col(raw)).when(F.col("_lc").isNull(), F.col("_ps")).when(~inside, 0.0)
    value = value.when(F.col("i") < F.col("_lc.i"), F.exp(-ul / kt))
    if right:
        value = value.when(F.col("i") > F.col("_rc.i"), F.exp(-ur / kt))
    return out.withColumn("p_wall", value.otherwise(F.col("_ps"))).drop("_ps", "_u", "_f", "_lc", "_rc", "_l0", "_r0", "_n")


# --- quality -----------------------------------------------------------------


def _energy(value: str, keys, kt: float = KT) -> Column:
    u = F.lit(-kt) * F.log(F.greatest(F.col(value), F.lit(1e-15)))
    return u


def force_consistency(curves: DataFrame, value: str = "p", threshold: float = 1.0, keys=KEYS) -> DataFrame:
    """Points of the valid range whose second force derivative exceeds the threshold, and their rate."""
    k = list(keys)
    out = with_force(curves.withColumn("u", _energy(value, keys)), "u", keys).withColumn("_n", F.max("i").over(_all(keys)))
    checked = out.where((F.col("i") >= F.greatest(F.lit(1), F.col("i_start"))) & (F.col("i") < F.least(F.col("_n"), F.col("i_end") + 1)))
    return checked.groupBy(*k).agg(F.count_if(F.abs("d2f") > threshold).alias("n_bad"), F.count(F.lit(1)).alias("n_checked")).withColumn(
        "rate", F.col("n_bad") / F.col("n_checked"))


def _roughness(curves: DataFrame, value: str, name: str, keys) -> DataFrame:
    """Sum of the squared second force derivative in the valid range times the bin width."""
    out = with_force(curves.withColumn("u", _energy(value, keys)), "u", keys)
    inside = F.col("i").between(F.col("i_start"), F.col("i_end"))
    step = F.max(F.when(F.col("i") == 1, F.col("x"))) - F.min("x")
    sums = out.groupBy(*keys).agg(step.alias("_h"), F.sum(F.when(inside, F.col("d2f") * F.col("d2f"))).alias("_s"))
    return sums.select(*keys, "_h", (F.col("_s") * F.col("_h")).alias(name))


def smoothing_quality(curves: DataFrame, raw: str = "p", smooth: str = "ps", keys=KEYS, raw_curves: DataFrame | None = None,
                      raw_keys=None) -> DataFrame:
    """Peak position, force roughness and peak height scores with their weighted total.

    With many smoothed variants of one curve, ``raw_curves`` and ``raw_keys`` let the
    raw side be measured once per curve.
    """
    k = list(keys)
    rk = list(raw_keys or keys)
    source = curves if raw_curves is None else raw_curves
    rough = _roughness(curves, smooth, "rough_smooth", k).join(_roughness(source, raw, "rough_raw", rk).drop("_h"), rk)
    pr = detect_peaks(source, raw, rk).select(*rk, "rank", F.col("x").alias("xr"), F.col("height").alias("hr"))
    ps = detect_peaks(curves, smooth, keys).select(*k, F.col("rank").alias("rank_s"), F.col("x").alias("xs"), F.col("height").alias("hs"))
    pairs = shuffled(rough.select(*k)).join(pr, rk).join(shuffled(ps), k, "left")  # at most 6 x 6 per curve
    same = (F.col("rank") == F.col("rank_s")) & (F.col("hr") > 0)
    near = pairs.groupBy(*k, "rank").agg(
        F.min(F.abs(F.col("xs") - F.col("xr"))).alias("_d"), F.max(F.when(same, F.abs(F.col("hs") - F.col("hr")) / F.col("hr"))).alias("_e")
    )
    # Added up by rank, so that equal curves get equal scores whatever order the rows come in.
    ranked = [F.max(F.when(F.col("rank") == n, F.col(c))).alias(f"{c}{n}") for c in ("_d", "_e") for n in range(1, MAX_PEAKS + 1)]
    mean = lambda c: sum((F.coalesce(f"{c}{n}", F.lit(0.0)) for n in range(1, MAX_PEAKS + 1)), F.lit(0.0)) / F.nullif(f"_n{c}", F.lit(0))
    errors = near.groupBy(*k).agg(*ranked, F.count("_d").alias("_n_d"), F.count("_e").alias("_n_e")).select(
        *k, mean("_d").alias("_pe"), mean("_e").alias("_he"), F.col("_n_d").alias("_m"))
    out = rough.join(errors, k, "left")
    total = F.col("rough_raw") + F.col("rough_smooth")

    def score(err):
        return F.when(F.col("_m").isNull(), 1.0).when(F.col("_m") == 0, 0.5).otherwise(F.lit(1.0) / (F.lit(1.0) + F.coalesce(err, F.lit(0.0))))

    out = out.withColumn("score_position", score(F.col("_pe") / F.col("_h"))).withColumn("score_height", score(F.col("_he")))
    out = out.withColumn("score_force", F.when(total > 0, F.col("rough_raw") / total).otherwise(1.0))
    out = out.withColumn("reduction", F.when(F.col("rough_raw") > 0, (F.col("rough_raw") - F.col("rough_smooth")) / F.col("rough_raw"))
                         .otherwise(F.when(F.col("rough_smooth") == 0, 0.0).otherwise(-1.0)))
    score_sum = sum((F.col(f"score_{n}") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("score", score_sum).drop("_h", "_pe", "_he", "_m")


# --- composed jobs -----------------------------------------------------------


def smooth_distributions(curves: DataFrame, kind: str, keys=KEYS, window: int = 11, order: int = 3, sigma: float = 3.0) -> DataFrame:
    """Range, zero fill, kind-specific smoothing with wall or far end, for all curves at once."""
    prepared = cut_lineage(interpolate_zeros(with_valid_range(curves, keys=keys), keys=keys))  # read for the arrays and for the ranges
    arrays = spread(to_arrays(prepared, keys), *keys)  # smoothing costs time by points, not by bytes
    if kind == "bond":
        smooth = savgol_smooth("ps", window, order)
    else:
        smooth = gaussian_smooth("ps", sigma, periodic=kind == "dihedral")
    long = from_arrays(arrays.withColumn("sm", smooth), ["ps", "sm"], keys).withColumnRenamed("ps", "p")
    span = prepared.select(*keys, "i", "i_start", "i_end")
    long = cut_lineage(shuffled(long).join(span, [*keys, "i"]))  # smoothed once for all readers
    if kind == "bond":
        return harmonic_boundaries(long, keys, smooth="sm", raw="p").withColumnRenamed("p_wall", "p_smooth").drop("sm")
    if kind == "rdf":
        walled = harmonic_boundaries(long, keys, threshold=0.1, smooth="sm", raw="p", right=False)
        peaks = detect_peaks(long, "p", keys)
        zoned = with_zones(walled, peaks, peak_width(long, peaks, keys), "rdf", keys=keys)
        return rdf_far_end(zoned, "p_wall", keys).withColumnRenamed("p_wall", "p_smooth").drop("sm", "zone")
    inside = F.col("i").between(F.col("i_start"), F.col("i_end"))
    keep = F.lit(True) if kind == "dihedral" else inside
    return long.withColumn("p_smooth", F.when(keep, F.col("sm")).otherwise(F.col("p"))).drop("sm")


# Grid of the smoothing sweep.
SWEEP = {
    "small": [0.5, 0.7, 0.9, 1.1, 1.3, 1.5],
    "large": [1.5, 2.1, 3.1, 4.1, 5.1],
    "order": [2, 3, 4],
    "width": [0.5, 1.0, 1.5, 2.0],
}


#: Curves to a task of the sweep; each makes 360 tries on the grid above.
SWEEP_CURVES = 48


def sweep_smoothing(curves: DataFrame, kind: str = "bond", base_window: int = 7, grid: dict | None = None, keys=KEYS) -> DataFrame:
    """Best parameters per curve out of the whole grid, scored by ``smoothing_quality``.

    Every distinct (window, order) is smoothed once per curve; the grid points pick
    from those arrays by zone. All tries of a curve are scored together (``best_try``).
    """
    g = grid or SWEEP
    k = list(keys)
    prepared = with_valid_range(curves, keys=keys)
    peaks = detect_peaks(prepared, "p", keys)
    widths = peak_width(prepared, peaks, keys)
    wins = {(odd_window(int(f * base_window), o), o) for f in g["small"] + g["large"] for o in g["order"]}
    order_of = {wo: place for place, wo in enumerate(sorted(wins))}
    matrices = [(w, np.array(savgol_matrix(w, o))) for w, o in order_of]
    # A few curves make much work: spread them whatever their size in bytes.
    prepared = cut_lineage(prepared)
    n_curves = prepared.select(*k).distinct().count()
    parts = max(
        int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions")), curves.sparkSession.sparkContext.defaultParallelism, -(-n_curves // SWEEP_CURVES))
    arrays = to_arrays(prepared, keys).repartition(parts, *k)
    long = from_arrays(arrays, ["ps"], keys).withColumnRenamed("ps", "p")
    long = shuffled(long).join(prepared.select(*k, "i", "i_start", "i_end"), [*k, "i"])
    for n, f in enumerate(g["width"]):
        long = with_zones(long, peaks, widths, kind, f, keys).withColumnRenamed("zone", f"zone_{n}")
    tk = ["small", "large", "order", "peak_factor"]
    tries = sorted({
        (float(a), float(b), int(o), float(f), n, order_of[(odd_window(int(a * base_window), o), o)], order_of[(odd_window(int(b * base_window), o), o)])
        for a in g["small"] for b in g["large"] for o in g["order"] for n, f in enumerate(g["width"])})
    tries = sorted({t[4:]: t for t in reversed(tries)}.values())  # of tries with the same windows and zones the first one wins
    packed = long.select(
        *k, "i", "x", F.greatest(F.lit(0.0), "p").alias("_p"), F.col("i").between(F.col("i_start"), F.col("i_end")).alias("_in"),
        F.array(*[f"zone_{n}" for n in range(len(g["width"]))]).alias("_zs"))
    tops = peaks.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("rank", "x", "height"))).alias("_pk"))
    raw = arrays.join(_roughness(prepared, "p", "_raw", k), k).join(tops, k, "left").select(
        *[F.col(c).alias(c) for c in k], "ps", "_raw", F.col("_pk.rank").alias("_rr"), F.col("_pk.x").alias("_rx"), F.col("_pk.height").alias("_rh"))
    types = {f.name: f.dataType.simpleString() for f in curves.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in k], "small double", "large double", "`order` int", "peak_factor double", "score double"])

    def best(points: pa.Table, of: pa.Table) -> pa.Table:
        if not points.num_rows:  # a curve without a key
            return pa.table([pa.array([], f.type) for f in of.select(k).schema] + [pa.array([], t) for t in numbers], [*k, *tk, "score"])
        score, at = best_try(points, of.to_pylist()[0], tries, matrices)
        return pa.table([*[of.column(c) for c in k], *[pa.array([v], t) for v, t in zip((*tries[at][:4], score), numbers)]], [*k, *tk, "score"])

    numbers = [pa.int32() if c == "order" else pa.float64() for c in (*tk, "score")]
    # The tries are never stored or shuffled: all of a curve are made at once, where its rows are.
    return packed.repartition(parts, *k).groupBy(*k).cogroup(raw.repartition(parts, *k).groupBy(*k)).applyInArrow(best, schema)


def _savgol(values: np.ndarray, window: int, matrix: np.ndarray) -> np.ndarray:
    """``savgol_smooth`` of one curve, added up in the same order."""
    n = len(values)
    if n < window:
        return values
    start = np.clip(np.arange(n) - window // 2, 0, n - window)
    rows = matrix[np.arange(n) - start]
    out = np.zeros(n)
    for c in range(window):
        out = out + rows[:, c] * values[start + c]
    return out


def _slopes(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``gradient`` along the last axis; a single point has none."""
    out = np.full(v.shape, np.nan)
    if len(x) < 2:
        return out
    h = np.diff(x)
    if not h.all():
        raise ZeroDivisionError("two points of a curve have the same x")
    hs, hd = h[:-1], h[1:]
    out[..., 1:-1] = (hs * hs * v[..., 2:] + (hd * hd - hs * hs) * v[..., 1:-1] - hd * hd * v[..., :-2]) / (hs * hd * (hd + hs))
    out[..., 0], out[..., -1] = (v[..., 1] - v[..., 0]) / h[0], (v[..., -1] - v[..., -2]) / h[-1]
    return out


def best_try(table: pa.Table, raw: dict, tries: list[tuple], matrices: list[tuple]) -> tuple[float, int]:
    """Score and place of the best of ``tries`` for the curve in ``table``; of equal scores the first one.

    A try is (small, large, order, factor, place of its zones in _zs, places in ``matrices`` of the filters for peaks and for valleys).
    All of them are rows of one array: zone by zone values, means at the borders of zones, then the rules of ``smoothing_quality``,
    for which ``raw`` has the values, the roughness and the peaks of the curve itself. A filter that meets a null gives 0, as a negative value does.
    """
    table = table.take(pc.sort_indices(table, sort_keys=[("i", "ascending")]))
    x, p, inside = (table.column(c).to_numpy() for c in ("x", "_p", "_in"))
    n = len(x)
    zone = table.column("_zs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T[[t[4] for t in tries]]
    absent = np.array([u is None for u in raw["ps"]])
    whole = np.array([0.0 if u is None else u for u in raw["ps"]])
    smooth = []
    for window, matrix in matrices:
        lost = absent if len(whole) < window else _savgol(absent.astype(float), window, np.ones_like(matrix)) > 0
        smooth.append(np.where(lost, 0.0, np.maximum(0.0, _savgol(whole, window, matrix)))[table.column("i").to_numpy()])
    smooth = np.array(smooth)
    near, far = smooth[[t[5] for t in tries]], smooth[[t[6] for t in tries]]
    v = np.where(zone == 1, near, np.where((zone == 2) | (zone == 3), far, p))
    turn = np.zeros(zone.shape, bool)
    turn[:, 1:] = zone[:, 1:] != zone[:, :-1]
    edge = turn[:, 1:-1] | turn[:, :-2] | turn[:, 2:]
    v[:, 1:-1] = np.where(edge, (v[:, :-2] + v[:, 1:-1] + v[:, 2:]) / 3.0, v[:, 1:-1])
    bend = _slopes(_slopes(-_slopes(-KT * np.log(np.maximum(v, 1e-15)), x), x), x)
    second = x[table.column("i").to_numpy() == 1]
    step = second.max() - x.min() if len(second) else np.nan
    known = inside & ~np.isnan(bend)
    # cumsum adds in the order of the grid, as equal curves are to get equal scores
    rough = np.where(known.any(axis=1), np.cumsum(np.where(known, bend * bend, 0.0), axis=1)[:, -1] * step, np.nan)
    slope = _slopes(v, x)
    hit = np.zeros(v.shape, bool)
    hit[:, :-1] = (slope[:, :-1] > 0) & (slope[:, 1:] <= 0)
    hit &= v >= MIN_HEIGHT * v.max(axis=1, keepdims=True)
    for t in np.flatnonzero(hit.sum(axis=1) > MAX_PEAKS):
        at = np.flatnonzero(hit[t])
        hit[t, at[np.lexsort((-at, -v[t, at]))[MAX_PEAKS:]]] = False
    rank = np.cumsum(hit, axis=1)
    found = hit.any(axis=1)
    ranks, xs, heights = (raw[c] or [] for c in ("_rr", "_rx", "_rh"))
    away, off, n_off = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
    for r, px, height in zip(ranks, xs, heights):
        away += np.where(found, np.where(hit, np.abs(x - px), np.inf).min(axis=1), 0.0)
        own = hit & (rank == r)
        paired = own.any(axis=1) & (height > 0)
        if height > 0:
            off += np.where(paired, np.abs(np.where(own, v, 0.0).sum(axis=1) - height) / height, 0.0)
        n_off += paired
    if ranks:
        apart = np.nan_to_num(away / len(ranks) / step)
        unlike = np.divide(off, n_off, out=np.zeros(len(v)), where=n_off > 0)
        position, likeness = (np.where(found, 1.0 / (1.0 + e), 0.5) for e in (apart, unlike))
    else:
        position = likeness = np.ones(len(v))
    total = (np.nan if raw["_raw"] is None else raw["_raw"]) + rough
    force = np.divide(raw["_raw"] or 0.0, total, out=np.ones(len(v)), where=total > 0)
    score = sum((s * w for s, w in zip((position, force, likeness), (WEIGHTS[c] for c in ("position", "force", "height")))), np.zeros(len(v)))
    at = int(score.argmax())
    return float(score[at]), at
