"""Binning, normalisation and histogram comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import col
from ..session import cut_lineage
from .skew import per_group


def bin_index(value, lo: float, hi: float, n: int) -> Column:
    """Equal bins on [lo, hi]; the last edge belongs to the last bin, outside is null."""
    v = col(value)
    width = (hi - lo) / n
    raw = F.floor((v - F.lit(float(lo))) / F.lit(float(width))).cast("bigint")
    return F.when((v >= lo) & (v <= hi), F.least(raw, F.lit(n - 1).cast("bigint")))


def bin_index_by_kind(value, ranges: dict[str, tuple[float, float, int]]) -> Column:
    """``bin_index`` with the range of the row's ``kind``; other kinds are null."""
    i = F.lit(None).cast("bigint")
    for kind, (lo, hi, n) in ranges.items():
        i = F.when(F.col("kind") == kind, bin_index(value, lo, hi, n)).otherwise(i)
    return i


def bin_counts(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, n: int) -> DataFrame:
    """One row per occupied (keys, bin), plus a null bin for samples out of range."""
    return df.groupBy(*keys, bin_index(value, lo, hi, n).alias("i")).agg(F.count(F.lit(1)).alias("n"))


def fill_bins(counts: DataFrame, keys: list[str], lo: float, hi: float, n: int, basis: str = "in_range") -> DataFrame:
    """Occupied bins to the full grid with a density.

    ``in_range`` divides by the samples inside [lo, hi], ``all`` by every sample,
    so that samples outside lower the curve.
    """
    width = float((hi - lo) / n)
    inside = F.col("i").isNotNull()
    per_key = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("n_in"),
        F.sum("n").alias("n_all"),
        F.map_from_entries(
            F.collect_list(F.when(inside, F.struct("i", "n")))
        ).alias("bins"),  # at most n entries per key
    )
    total = F.col("n_in") if basis == "in_range" else F.col("n_all")
    grid = per_key.select(
        *keys, "n_in", "n_all", "bins",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("i"),
    )
    cnt = F.coalesce(F.try_element_at("bins", F.col("i")), F.lit(0)).cast("bigint")
    return grid.select(
        *keys,
        "i",
        (F.lit(float(lo)) + (F.col("i").cast("double") + 0.5) * F.lit(width)).alias("x"),
        cnt.alias("n"),
        F.when(total > 0, cnt.cast("double") / (total.cast("double") * F.lit(width))).otherwise(0.0).alias("density"),
    )


def histogram(
    df: DataFrame, keys: list[str], value: str, lo: float, hi: float, n: int, basis: str = "in_range"
) -> DataFrame:
    """Density histogram per key; only partial counts are shuffled."""
    return fill_bins(bin_counts(df, keys, value, lo, hi, n), keys, lo, hi, n, basis)


def normalise_curve(curves: DataFrame, mode: str, keys=("curve_id",)) -> DataFrame:
    """p divided by its trapezoid area or by its maximum; left alone when that is not positive."""
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("i")
    if mode == "area":
        strip = (F.col("x") - F.lag("x").over(ordered)) * (F.col("p") + F.lag("p").over(ordered)) / F.lit(2.0)
        scaled = curves.withColumn("_strip", strip).withColumn("_norm", F.sum("_strip").over(whole)).drop("_strip")
    else:
        scaled = curves.withColumn("_norm", F.max("p").over(whole))
    return scaled.withColumn("p", F.when(F.col("_norm") > 0, F.col("p") / F.col("_norm")).otherwise(F.col("p"))).drop("_norm")


def js_divergence(pairs: DataFrame, keys: list[str], p: str = "p", q: str = "q") -> DataFrame:
    """Base-2 Jensen-Shannon divergence of two aligned curves per key.

    Both are normalised to one; the logarithms see values clipped to [1e-12, 1].
    """
    eps = 1e-12
    sums = pairs.groupBy(*keys).agg(F.sum(p).alias("_sp"), F.sum(q).alias("_sq"))

    def unit(c, total):
        return F.when(F.col(total) > 0, F.col(c) / F.col(total)).otherwise(F.col(c))

    norm = pairs.join(sums, keys).select(*keys, unit(p, "_sp").alias("_p"), unit(q, "_sq").alias("_q"))
    norm = norm.withColumn("_m", (F.col("_p") + F.col("_q")) / 2.0)

    def clip(c):
        return F.greatest(F.lit(eps), F.least(F.lit(1.0), F.col(c) / F.lit(1.0 + eps)))

    def term(a):
        return clip(a) * F.log2(clip(a) / clip("_m"))

    return norm.groupBy(*keys).agg(F.sum(term("_p")).alias("kl_p"), F.sum(term("_q")).alias("kl_q")).withColumn(
        "js", (F.col("kl_p") + F.col("kl_q")) / 2.0
    )


def interpolate_uniform(points: DataFrame, grid: DataFrame, keys: list[str], lo: float, step: float) -> DataFrame:
    """Linear interpolation of a uniform grid (keys, i, x, p) at ``points`` (keys, x) as ``q``.

    The lower neighbour follows from the grid arithmetic, so both neighbours are equi joins.
    """
    k = F.floor((F.col("x") - F.lit(lo)) / F.lit(step))
    at = points.withColumn("_k", k).withColumn("_t", (F.col("x") - F.lit(lo)) / F.lit(step) - k)
    low = grid.select(*keys, F.col("i").alias("_k"), F.col("p").alias("_p0"))
    high = grid.select(*keys, (F.col("i") - 1).alias("_k"), F.col("p").alias("_p1"))
    joined = at.join(low, [*keys, "_k"], "left").join(high, [*keys, "_k"], "left")
    q = F.col("_p0") + (F.coalesce("_p1", "_p0") - F.col("_p0")) * F.col("_t")
    return joined.withColumn("q", q).drop("_k", "_t", "_p0", "_p1")


#: Bins of the density estimate per kernel width, and reach of the kernel in widths.
KDE_BINS, KDE_REACH = 64, 8.5


def kernel_density(samples: DataFrame, keys: list[str], value: str, lo: float, hi: float, points: int, factor: float = 1.0) -> DataFrame:
    """Gaussian density on a fixed grid, width factor * n^(-1/5) * sample deviation; zero below two samples.

    Samples are binned first, ``KDE_BINS`` bins to a kernel width, each with its number, mean and spread. A bin adds to the
    grid points within ``KDE_REACH`` widths the kernel at its mean with the second-order term of its spread. What is left out is
    under 1e-6 of a kernel's height for each sample: at most 1.4 / 48 / KDE_BINS^3 of it from higher orders, 2e-16 from the cut.
    """
    stats = samples.groupBy(*keys).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_s"))
    stats = cut_lineage(stats.withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * factor))
    step = float((hi - lo) / (points - 1))
    wide = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    wide = per_group(wide, stats.where("_n >= 2 AND _h > 0"), keys).where("_h IS NOT NULL")
    binned = wide.groupBy(*keys, "_h", F.floor(F.col("_v") / F.col("_h") * KDE_BINS).alias("_b")).agg(
        F.count(F.lit(1)).alias("_w"), F.avg("_v").alias("_m"), (F.var_pop("_v") * F.count(F.lit(1))).alias("_q"))
    near = lambda side: (F.col("_m") + F.lit(side * KDE_REACH) * F.col("_h") - F.lit(float(lo))) / F.lit(step)
    first = F.greatest(F.ceil(near(-1)), F.lit(0)).cast("bigint")
    last = F.least(F.floor(near(1)), F.lit(points - 1)).cast("bigint")
    spread = binned.withColumn("_i0", first).withColumn("_i1", last).where("_i0 <= _i1").select(
        *keys, "_h", "_w", "_m", "_q", F.explode(F.sequence("_i0", "_i1")).alias("i"))
    z = (F.lit(float(lo)) + F.col("i").cast("double") * F.lit(step) - F.col("_m")) / F.col("_h")
    part = F.exp(F.lit(-0.5) * z * z) * (F.col("_w") + F.lit(0.5) * (z * z - 1.0) * F.col("_q") / (F.col("_h") * F.col("_h")))
    sums = spread.groupBy(*keys, "i").agg(F.sum(part).alias("_k"))
    grid = stats.select(*keys, "_n", "_h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("i"))
    dens = F.coalesce("_k", F.lit(0.0)) / (F.col("_n") * F.col("_h") * F.lit(2.5066282746310002))
    return grid.join(sums, [*keys, "i"], "left").select(
        *keys, "i", (F.lit(float(lo)) + F.col("i").cast("double") * F.lit(step)).alias("x"), F.when((F.col("_n") >= 2) & (F.col("_h") > 0), dens).otherwise(0.0).alias("density"))


def ks_two_sample(a: DataFrame, b: DataFrame, keys: list[str], value: str, block: float) -> DataFrame:
    """Two-sample statistic D and its limiting p value per key.

    Values are counted first; the cumulative counts run in blocks of the value axis.
    """
    from .ordered import blocked_running_sum

    both = a.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    merged = both.groupBy(*keys, "_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    totals = merged.groupBy(*keys).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"))
    cum = blocked_running_sum(merged, keys, "_v", ["_a", "_b"], block=block)
    d = F.max(F.abs(F.col("_a_cum") / F.col("n1") - F.col("_b_cum") / F.col("n2")))
    out = cum.join(totals, keys).where("n1 > 0 AND n2 > 0").groupBy(*keys, "n1", "n2").agg(d.alias("d"))
    lam2 = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")) * F.col("d") * F.col("d")
    p = F.lit(0.0)
    for k in range(1, 101):
        p = p + F.lit(2.0 if k % 2 else -2.0) * F.exp(F.lit(-2.0 * k * k) * lam2)
    return out.withColumn("p_value", F.when(F.col("d") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))


def goodness_of_fit(rows: DataFrame, keys: list[str], y: str, fit: str) -> DataFrame:
    """RMSE and R^2 per key; without variance R^2 is 1 for an exact fit, else 0."""
    d = F.col(y) - F.col(fit)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("_ssr"), F.var_pop(y).alias("_var")
    )
    sst = F.col("_var") * F.col("n")
    r2 = F.when(sst > 1e-30, F.lit(1.0) - F.col("_ssr") / sst).otherwise(F.when(F.col("_ssr") <= 1e-30, 1.0).otherwise(0.0))
    return sums.select(*keys, "n", F.sqrt(F.col("_ssr") / F.col("n")).alias("rmse"), r2.alias("r2"))


def binned_by_kind(values: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float, int]]) -> DataFrame:
    """One pass over (kind, value): bin counts with a range per kind."""
    i = F.lit(None).cast("bigint")
    x = F.lit(None).cast("double")
    width = F.lit(None).cast("double")
    for kind, (lo, hi, n) in ranges.items():
        is_kind = F.col("kind") == kind
        b = bin_index("value", lo, hi, n)
        i = F.when(is_kind, b).otherwise(i)
        w = (hi - lo) / n
        x = F.when(is_kind, F.lit(float(lo)) + (F.col("i").cast("double") + 0.5) * F.lit(float(w))).otherwise(x)
        width = F.when(is_kind, F.lit(float(w))).otherwise(width)
    counts = values.groupBy(*keys, i.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return counts.where("i IS NOT NULL").join(totals, keys).select(
        *keys, "i", x.alias("x"), "n", (F.col("n") / (F.col("_all") * width)).alias("density")
    )


def chain_statistics(chains: DataFrame, min_length: int, keys=()) -> DataFrame:
    """Mn, Mw and PDI over chains of at least ``min_length``; none left fails the query."""
    n = F.col("n")
    out = chains.where(n >= min_length).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chains"), F.sum(n).alias("n_units"), F.avg(n).alias("mn"), (F.sum(n * n) / F.sum(n)).alias("mw")
    )
    checked = F.when(F.col("n_chains") > 0, F.col("n_chains")).otherwise(F.raise_error(F.lit("no chain is long enough")).cast("bigint"))
    return out.withColumn("n_chains", checked).withColumn("pdi", F.col("mw") / F.col("mn"))
