"""Theoretical chain-length distributions evaluated on a grid per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import col, log_gamma

MODELS = ("schulz-zimm", "poisson", "lognormal")


def log_density(model, n, mn, pdi) -> Column:
    """Unnormalised log density; constants cancel in the normalisation."""
    m, x, mean, spread = col(model), col(n), col(mn), col(pdi)
    k = F.lit(1.0) / (spread - 1.0)
    schulz = (k - 1.0) * F.log(x) - x * k / mean
    nu = F.greatest(mean - 1.0, F.lit(1e-12))
    poisson = (x - 1.0) * F.log(nu) - nu - log_gamma(x)
    var = F.log(spread)
    mu = F.log(mean) - var / 2.0
    dev = F.log(x) - mu
    lognormal = -(dev * dev) / (var * 2.0) - F.log(x)
    return F.when(m == "schulz-zimm", schulz).when(m == "poisson", poisson).otherwise(lognormal)


def theory_curves(params: DataFrame, keys: list[str], grid_points: int, x_lo, x_hi) -> DataFrame:
    """One normalised curve per (keys, model) from columns ``mn`` and ``pdi``.

    Groups with parameters a model cannot take are left out of that model:
    mn > 1 for poisson, mn > 0 and pdi > 1 for the two others.
    """
    models = F.explode(F.array(*[F.lit(m) for m in MODELS]))
    valid = F.when(F.col("model") == "poisson", F.col("mn") > 1).otherwise((F.col("mn") > 0) & (F.col("pdi") > 1))
    base = params.select(*keys, "mn", "pdi", col(x_lo).alias("_lo"), col(x_hi).alias("_hi"), models.alias("model"))
    grid = base.where(valid).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid_points - 1).cast("bigint"))).alias("i")
    ).withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i").cast("double") / F.lit(float(grid_points - 1)))
    whole = Window.partitionBy(*keys, "model")
    ordered = whole.orderBy("i")
    out = grid.withColumn("_l", log_density("model", "x", "mn", "pdi"))
    out = out.withColumn("_d", F.exp(F.col("_l") - F.max("_l").over(whole)))
    strip = (F.col("x") - F.lag("x").over(ordered)) * (F.col("_d") + F.lag("_d").over(ordered)) / 2.0
    out = out.withColumn("_s", strip).withColumn("_area", F.sum("_s").over(whole))
    pdi = F.when(F.col("model") == "poisson", F.lit(1.0) + F.lit(1.0) / (F.col("mn") - 1.0)).otherwise(F.col("pdi"))
    return out.select(*keys, "model", "i", "x", (F.col("_d") / F.col("_area")).alias("p"), pdi.alias("pdi"))
