"""Reactivity ratios from per-cycle counts (traj, cycle, n1..n6, E.., N..)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import safe_ratio
from ..session import cut_lineage
from .ordered import blocked_running_sum, bucketed_row_number

CHANNELS = ("11", "12", "21", "22")
# Exposure column of each channel.
EXPOSURE = {"11": "E35", "12": "E36", "21": "E45", "22": "E46"}
ESTIMATES = ("r1_bulk", "r2_bulk", "r1_cand", "r2_cand")


def census(points: DataFrame, keys: list[str], n_types: int = 6) -> DataFrame:
    """n1..n6 per frame, zero filled."""
    return points.groupBy(*keys).agg(*[F.count_if(F.col("type") == k).alias(f"n{k}") for k in range(1, n_types + 1)])


def _sums() -> list[Column]:
    return [F.sum(f"N{c}").alias(f"N{c}") for c in CHANNELS] + [F.sum(e).alias(e) for e in EXPOSURE.values()] + [
        F.sum("n5").alias("s5"), F.sum("n6").alias("s6"), F.count(F.lit(1)).alias("rows"),
    ]


def estimates_from_sums(sums: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """r1 and r2 from summed columns, normalised by monomer counts and by candidate pairs."""
    n5, n6 = F.col("s5") / F.col("rows"), F.col("s6") / F.col("rows")
    bad = (F.col("s5") <= 0) | (F.col("s6") <= 0)
    fail = F.raise_error(F.lit("monomer count is not positive")).cast("double") if strict else F.lit(None).cast("double")

    def cand(a, b):
        return safe_ratio(safe_ratio(f"N{a}", EXPOSURE[a]), safe_ratio(f"N{b}", EXPOSURE[b]))

    return sums.select(
        *keys,
        F.when(bad, fail).otherwise(safe_ratio("N11", "N12") * (n6 / n5)).alias("r1_bulk"),
        F.when(bad, fail).otherwise(safe_ratio("N22", "N21") * (n5 / n6)).alias("r2_bulk"),
        cand("11", "12").alias("r1_cand"),
        cand("22", "21").alias("r2_cand"),
    )


def point_estimates(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = list(keys or [])
    return estimates_from_sums(counts.groupBy(*keys).agg(*_sums()), keys)


def with_conversion(counts: DataFrame, keys: list[str]) -> DataFrame:
    """X = 1 - (n5 + n6) / first (n5 + n6) of the trajectory."""
    monomer = F.col("n5") + F.col("n6")
    firsts = counts.groupBy(*keys).agg(F.min_by(monomer, "cycle").alias("_n0"))
    joined = counts.join(firsts, keys) if keys else counts.withColumn("_n0", firsts.scalar())
    return joined.withColumn("X", F.lit(1.0) - monomer.cast("double") / F.col("_n0").cast("double")).drop("_n0")


def window_estimates(counts: DataFrame, keys: list[str], widths: tuple[int, ...]) -> DataFrame:
    """Estimates in equal windows of conversion, for all window numbers in one job.

    The windows span 0 to the conversion of the last row.
    """
    series = with_conversion(counts, keys)
    last = series.agg(F.max_by("X", F.struct(*keys, "cycle")).alias("x")).scalar()
    wide = series.select("*", F.explode(F.array(*[F.lit(w).cast("bigint") for w in widths])).alias("n_windows"))
    step = last / F.col("n_windows").cast("double")
    raw = F.floor(F.col("X") / step)
    exact = raw + F.when((raw + 1).cast("double") * step <= F.col("X"), 1).when(raw.cast("double") * step > F.col("X"), -1).otherwise(0)
    slot = F.greatest(F.lit(0).cast("bigint"), F.least(exact, F.col("n_windows") - 1))
    tagged = wide.withColumn("window", slot)
    f1 = F.col("n5").cast("double") / (F.col("n5") + F.col("n6")).cast("double")
    sums = tagged.groupBy("n_windows", "window").agg(*_sums(), F.avg("X").alias("X_mid"), F.avg(f1).alias("f1"))
    total = F.col("N11") + F.col("N12") + F.col("N21") + F.col("N22")
    est = estimates_from_sums(sums, ["n_windows", "window", "X_mid", "f1", "N11", "N12", "N21", "N22"])
    return est.select(
        "n_windows", "window", "X_mid", "f1",
        F.when(total > 0, (F.col("N11") + F.col("N21")) / total).alias("F1_inst"), total.alias("n_events"), *ESTIMATES,
    )


def channel_rates(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Events per monomer and per candidate pair, one row per cycle and channel."""
    parts = F.array(*[
        F.struct(
            F.lit(c).alias("channel"), F.col(f"N{c}").alias("n"), F.col(EXPOSURE[c]).alias("exposure"),
            F.col("n5" if c in ("11", "21") else "n6").alias("monomer"),
        ) for c in CHANNELS
    ])
    long = counts.select(*keys, F.inline(parts))
    return long.groupBy("channel").agg(
        F.sum("n").alias("n_events"), (F.sum("n") / F.avg("monomer")).alias("rho"), (F.sum("n") / F.sum("exposure")).alias("pi")
    )


def diagnostics(counts: DataFrame, keys: list[str], windows: int = 20) -> DataFrame:
    series = with_conversion(counts, keys)
    ends = series.groupBy(*keys).agg(F.max_by("X", "cycle").alias("x")).agg(F.avg("x").alias("x")).scalar()
    empty = window_estimates(counts, keys, (windows,)).agg(F.count_if(F.col("n_events") == 0).alias("n")).scalar()
    total = sum((F.sum(f"N{c}") for c in CHANNELS[1:]), F.sum("N11"))
    active = F.avg("n3") + F.avg("n4")
    pairs = sum((F.avg(e) for e in ("E36", "E45", "E46")), F.avg("E35"))
    out = counts.agg(
        F.count(F.lit(1)).alias("n_cycles"), *[F.sum(f"N{c}").alias(f"N{c}") for c in CHANNELS],
        F.when(active > 0, total / F.count(F.lit(1)) / active).alias("events_per_active_center"),
        pairs.alias("candidate_pairs"),
    )
    return out.withColumn("conversion_final", ends).withColumn("zero_event_windows", empty)


def concentration_report(counts: DataFrame, keys: list[str]) -> DataFrame:
    """first, last, min, max and mean of the composition columns, one row per quantity."""
    series = with_conversion(counts, keys)
    n5, n6 = F.col("n5").cast("double"), F.col("n6").cast("double")
    items = {"n5": n5, "n6": n6, "n6/n5": F.when(n5 != 0, n6 / n5), "f1": n5 / (n5 + n6), "X": F.col("X")}
    long = series.select(
        F.struct(*keys, "cycle").alias("_o"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("quantity"), v.alias("v")) for k, v in items.items()])),
    )
    return long.groupBy("quantity").agg(
        F.min_by("v", "_o").alias("first"), F.max_by("v", "_o").alias("last"),
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.count("v").alias("n"),
    )


def json_summary(columns: list[str]) -> Column:
    """Columns of a row as one JSON object, in order; what is null, not a number or infinite is null in it."""
    values = [F.col(c) for c in columns]
    finite = [F.when(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))), v).alias(c) for v, c in zip(values, columns)]
    return F.to_json(F.struct(*finite), {"ignoreNullFields": "false"})


def cumulative_events(counts: DataFrame, keys: list[str]) -> DataFrame:
    total = F.col("N11") + F.col("N12") + F.col("N21") + F.col("N22")
    names = [f"N{c}" for c in CHANNELS] + ["N_total"]
    return blocked_running_sum(counts.withColumn("N_total", total), keys, "cycle", names)


def global_cycles(frames: DataFrame, run: str, order: str, block: int = 65536) -> DataFrame:
    """Cycle number inside the run and continued over the runs in their order."""
    local = bucketed_row_number(frames, [run], F.floor(F.col(order) / F.lit(block)), [order], "local_cycle")
    sizes = frames.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    base = blocked_running_sum(sizes, [], run, ["_n"], block=4096).select(run, (F.col("_n_cum") - F.col("_n")).alias("_base"))
    return local.join(base, run).withColumn("cycle_no", F.col("_base") + F.col("local_cycle")).drop("_base")


def with_blocks(counts: DataFrame, keys: list[str], n_blocks: int, block: int = 65536) -> DataFrame:
    """Contiguous blocks of nearly equal size inside each trajectory; earlier blocks take the remainder."""
    ranked = bucketed_row_number(counts, keys, F.floor(F.col("cycle") / F.lit(block)), ["cycle"], "_rn")
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(sizes, keys)
    k = F.lit(n_blocks)
    q, rest = F.floor(F.col("_n") / k), F.col("_n") % k
    big = rest * (q + 1)
    r0 = F.col("_rn") - 1
    small = F.when(q > 0, rest + F.floor((r0 - big) / F.greatest(q, F.lit(1)))).otherwise(r0)
    return joined.withColumn("block", F.when(r0 < big, F.floor(r0 / (q + 1))).otherwise(small) + 1).drop("_rn", "_n")


def scrambled(rep: str, slot: str, seed: int) -> Column:
    """Deterministic pseudo-random bigint from two counters: two rounds of a 31-bit congruential step."""
    h = F.col(rep) * 7919 + F.col(slot) * 104729 + F.lit(seed)
    for _ in range(3):
        h = (h.bitwiseXOR(F.shiftright(h, 13)) * 1103515245 + 12345) % 2147483648
    return F.shiftright(h, 12)


def block_bootstrap(counts: DataFrame, keys: list[str], n_blocks: int = 20, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """95 % intervals of the estimates from resampled blocks.

    Blocks are summed once; a resample adds up block sums, so its cost does not
    depend on the number of cycles. At most ``n_blocks`` rounded up per
    trajectory rows take part in the join.
    """
    n_traj = counts.select(*keys).distinct().count() if keys else 1
    per = max(1, -(-n_blocks // n_traj))
    blocks = with_blocks(counts, keys, per).groupBy(*keys, "block").agg(*_sums())
    numbered = blocks.withColumn("_idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys, "block")) - 1)
    numbered = cut_lineage(numbered)
    total = numbered.count()  # a short trajectory has fewer blocks than asked for
    spark = counts.sparkSession
    draws = spark.range(n_boot).select(
        F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(total - 1).cast("bigint"))).alias("slot")
    ).withColumn("_idx", scrambled("rep", "slot", seed) % total)
    names = [f"N{c}" for c in CHANNELS] + list(EXPOSURE.values()) + ["s5", "s6", "rows"]
    sums = draws.join(numbered, "_idx").groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])
    est = estimates_from_sums(sums, ["rep"])
    long = est.select(F.inline(F.array(*[F.struct(F.lit(e).alias("estimate"), F.col(e).alias("v")) for e in ESTIMATES])))
    return long.where("v IS NOT NULL").groupBy("estimate").agg(
        F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"), F.count("v").alias("n")
    )


def _paths(targets: np.ndarray, r1: np.ndarray, r2: np.ndarray, f0: np.ndarray) -> np.ndarray:
    """Composition at each conversion of ``targets`` (paths x windows), integrated from f0 at conversion 0 in four steps a window."""

    def slope(x, f):
        g = 1.0 - f
        den = r1 * f * f + 2.0 * f * g + r2 * g * g
        return (f - (r1 * f * f + f * g) / den) / (1.0 - x)

    out, f, x = np.empty_like(targets), f0.astype(float), np.zeros(len(targets))
    for k in range(targets.shape[1]):
        h = (targets[:, k] - x) / 4.0
        for _ in range(4):
            k1 = slope(x, f)
            k2 = slope(x + h / 2, f + h * k1 / 2)
            k3 = slope(x + h / 2, f + h * k2 / 2)
            k4 = slope(x + h, f + h * k3)
            f = np.clip(f + h * (k1 + 2 * k2 + 2 * k3 + k4) / 6, 0.0, 1.0)
            x = x + h
        x = targets[:, k]
        out[:, k] = f
    return out


#: Bounds of both ratios, and the points from which the fit starts.
RATIO_BOUNDS = (1e-3, 100.0)
STARTS = ((1.0, 1.0), (0.5, 0.5), (2.0, 2.0), (0.3, 3.0))


def _least_squares(targets: np.ndarray, seen: np.ndarray, f0: np.ndarray, start: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Damped Gauss-Newton for all paths at once, in the logarithms of the ratios: (ratios, squared errors)."""
    low, high = np.log(RATIO_BOUNDS)
    left = lambda q: _paths(targets, np.exp(q[:, 0]), np.exp(q[:, 1]), f0) - seen
    at = np.clip(np.log(start), low, high)
    error = left(at)
    cost, damp = (error**2).sum(axis=1), np.full(len(at), 1e-3)
    for _ in range(rounds):
        step = 1e-6
        slopes = np.stack([(left(at + np.eye(2)[k] * step) - error) / step for k in (0, 1)], axis=2)
        normal = np.einsum("pwi,pwj->pij", slopes, slopes)
        down = np.einsum("pwi,pw->pi", slopes, error)
        diag = np.einsum("pii->pi", normal) + 1e-300
        solved = normal + damp[:, None, None] * (np.eye(2) * diag[:, :, None])
        det = solved[:, 0, 0] * solved[:, 1, 1] - solved[:, 0, 1] * solved[:, 1, 0]
        det = np.where(np.abs(det) > 0, det, 1e-300)
        move = -np.stack([solved[:, 1, 1] * down[:, 0] - solved[:, 0, 1] * down[:, 1], solved[:, 0, 0] * down[:, 1] - solved[:, 1, 0] * down[:, 0]], axis=1) / det[:, None]
        tried = np.clip(at + np.clip(np.nan_to_num(move), -2.0, 2.0), low, high)
        new = left(tried)
        new_cost = (new**2).sum(axis=1)
        better = new_cost < cost
        settled = np.where(better, cost - new_cost <= 1e-14 * cost, damp > 1e10)
        at, error = np.where(better[:, None], tried, at), np.where(better[:, None], new, error)
        cost, damp = np.where(better, new_cost, cost), np.where(better, damp / 5.0, damp * 4.0)
        if settled.all():
            break
    return np.exp(at), cost


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("r1", "r2", "sse")]))
def _fitted(xs: pd.Series, fs: pd.Series, f0: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out, sizes = np.zeros((len(xs), 3)), xs.map(len).to_numpy()
    for size in np.unique(sizes):  # all rows whose paths have the same length at once
        at = np.flatnonzero(sizes == size)
        targets, seen = np.stack(xs.iloc[at].to_list()), np.stack(fs.iloc[at].to_list())
        out[at, :2], out[at, 2] = _least_squares(targets, seen, f0.to_numpy()[at], np.stack([a.to_numpy()[at], b.to_numpy()[at]], axis=1))
    return pd.DataFrame(out, columns=["r1", "r2", "sse"])


def composition_fit(windows: DataFrame, keys: list[str], f0: Column | None = None) -> DataFrame:
    """r1 and r2 from (X_mid, f1) by least squares of the integrated composition path, within ``RATIO_BOUNDS``.

    The rows of a run are its conversion windows, a few dozen. Every run starts from each of ``STARTS``, all of
    them at once, and the smallest error wins, of equal ones the first start. Fewer than three
    windows give nulls; ``identifiable`` asks for a span of 0.1 in f1.
    """
    path = F.array_sort(F.collect_list(F.struct("X_mid", "f1")))
    runs = windows.where("f1 IS NOT NULL").groupBy(*keys).agg(path.alias("_p"), (F.max("f1") - F.min("f1")).alias("f1_delta"))
    runs = runs.withColumn("_f0", f0 if f0 is not None else F.col("_p")[0]["f1"])
    starts = F.array(*[F.struct(F.lit(k).alias("_start"), F.lit(a).alias("_a"), F.lit(b).alias("_b")) for k, (a, b) in enumerate(STARTS)])
    tried = runs.where(F.size("_p") >= 3).select(*keys, "_p", "_f0", F.inline(starts))
    found = tried.withColumn("_r", _fitted(F.col("_p.X_mid"), F.col("_p.f1"), F.col("_f0"), F.col("_a"), F.col("_b")))
    best = found.groupBy(*keys).agg(F.min(F.struct("_r.sse", "_start", "_r.r1", "_r.r2")).alias("_best"))
    fitted = best.select(*keys, F.col("_best.r1").alias("r1_ml"), F.col("_best.r2").alias("r2_ml"), F.col("_best.sse").alias("sse"))
    joined = runs.select(*keys, "f1_delta").join(fitted, keys, "left")
    return joined.withColumn("identifiable", F.col("r1_ml").isNotNull() & (F.col("f1_delta") >= 0.1))
