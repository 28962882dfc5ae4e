"""Spline mixing, least squares, binned densities, best-score smoothing and sectioned files against NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beadloom.operators import curves as C
from beadloom.operators import fits, reactivity
from beadloom.operators import histograms as H
from beadloom.sources import tables


def dense_spline(x, y):
    """Second derivatives by a dense solve of the same conditions."""
    n, h = len(x), np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = 1 / h[0], -1 / h[0] - 1 / h[1], 1 / h[1]
    a[-1, -3:] = 1 / h[-2], -1 / h[-2] - 1 / h[-1], 1 / h[-1]
    return np.linalg.solve(a, b)


def test_spline_is_the_dense_solution_and_exact_for_cubics(spark):
    rng = random.Random(1)
    curves = {}
    for k, n in enumerate((4, 5, 9, 30, 30)):
        x = np.cumsum([rng.uniform(0.1, 1.0) for _ in range(n)])
        curves[k] = (x, np.array([rng.uniform(-1, 1) for _ in range(n)]) if k < 4 else x**3 - 2 * x)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in curves.items() for a, b in zip(x, y, strict=True)], "c long, x double, v double")
    got = fits.spline_intervals(df, ["c"], "v")
    for k, (x, y) in curves.items():
        rows = got.where(F.col("c") == k).orderBy("k").collect()
        want = dense_spline(x, y)
        assert [r["m0"] for r in rows] == pytest.approx(want[:-1].tolist(), abs=1e-8) and rows[-1]["m1"] == pytest.approx(want[-1], abs=1e-8)
    mid = (F.col("x0") + F.col("x1")) / 2
    value, slope = fits.spline_value(mid)
    for r in got.where("c = 4").select(mid.alias("r"), value.alias("v"), slope.alias("d")).collect():
        assert (r["v"], r["d"]) == (pytest.approx(r["r"] ** 3 - 2 * r["r"], rel=1e-9, abs=1e-9), pytest.approx(3 * r["r"] ** 2 - 2, rel=1e-8, abs=1e-8))


def test_mixed_force_is_the_slope_of_the_mixed_energy(spark):
    lj = lambda x, s, e: 4 * e * ((s / x) ** 12 - (s / x) ** 6)
    rows = [(k, i, 0.9 * s + i * w, lj(0.9 * s + i * w, s, e)) for k, s, e, w in ((1, 3.0, 0.2, 0.03), (2, 3.3, 0.5, 0.027), (3, 3.1, 0.1, 0.05)) for i in range(400)]
    tables_ = spark.createDataFrame(rows, "table_id long, i long, x double, u double")
    pairs = spark.createDataFrame([(1, 2), (3, 3), (2, 3), (1, 9)], "a long, b long")
    for mode in ("geometric", "arithmetic"):
        got = fits.mix_tables(tables_, pairs, mode).orderBy("a", "b", "i").collect()
        assert {(r["a"], r["b"]) for r in got} == {(1, 2), (3, 3), (2, 3)} and len(got) == 3 * 401
        for pair in ((1, 2), (2, 3)):
            own = [r for r in got if (r["a"], r["b"]) == pair]
            x, u, f = (np.array([r[c] for r in own]) for c in "xuf")
            inner = slice(20, -20)
            same = np.abs(x[inner] - own[0]["sigma_mix"]) > 0.2  # the root of a product has an edge where it is zero
            assert np.abs(f[inner] + np.gradient(u, x)[inner])[same].max() < 0.02


def test_fit_recovers_ratios_and_agrees_with_a_search(spark):
    x = np.linspace(0.02, 0.85, 25)
    runs = {(2.0, 0.6): 0.4, (0.3, 0.25): 0.7, (5.0, 8.0): 0.35, (1.0, 1.0): 0.5}
    rows = []
    for n, ((a, b), f0) in enumerate(runs.items()):
        path = reactivity._paths(x[None, :], np.array([a]), np.array([b]), np.array([f0]))[0]
        rows += [(n, float(p), float(f)) for p, f in zip(x, path, strict=True)]
    rows += [(9, 0.1, 0.5), (9, 0.2, 0.4)]
    df = spark.createDataFrame(rows, "run long, X_mid double, f1 double")
    f0 = F.element_at(F.create_map(*[F.lit(v) for n, v in enumerate([*runs.values()]) for v in (n, v)], F.lit(9), F.lit(0.5)), F.col("run").cast("int"))
    got = {r["run"]: r for r in reactivity.composition_fit(df, ["run"], f0).collect()}
    for n, (a, b) in enumerate(list(runs)[:3]):
        assert (got[n]["r1_ml"], got[n]["r2_ml"]) == (pytest.approx(a, rel=1e-4), pytest.approx(b, rel=1e-4)) and got[n]["sse"] < 1e-12
    assert got[3]["sse"] < 1e-12 and not got[3]["identifiable"] and got[9]["r1_ml"] is None
    noisy = np.clip(reactivity._paths(x[None, :], np.array([2.0]), np.array([0.6]), np.array([0.4]))[0] + 0.01 * np.sin(40 * x), 0, 1)
    best, cost = reactivity._least_squares(np.repeat(x[None, :], 4, 0), np.repeat(noisy[None, :], 4, 0), np.full(4, 0.4), np.array(reactivity.STARTS))
    grid = np.exp(np.stack(np.meshgrid(np.linspace(-1, 2, 61), np.linspace(-2, 1, 61)), axis=-1).reshape(-1, 2))
    seen = reactivity._paths(np.repeat(x[None, :], len(grid), 0), grid[:, 0], grid[:, 1], np.full(len(grid), 0.4))
    assert cost.min() <= ((seen - noisy) ** 2).sum(axis=1).min() + 1e-12 and np.ptp(cost) < 1e-9
    assert (best >= 1e-3).all() and (best <= 100.0).all()


def test_binned_density_is_the_sum_over_samples(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(0, 1, 4000), 1: np.repeat([1.5, -2.0], [3, 5]), 2: np.array([0.5]), 3: np.full(6, 0.25), 4: rng.uniform(-400, 400, 500)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None)]
    got = H.kernel_density(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", -5.0, 5.0, 101)
    out = {(r["g"], r["i"]): r["density"] for r in got.collect()}
    assert len(out) == 5 * 101
    x = np.linspace(-5, 5, 101)
    for k, vs in groups.items():
        n = len(vs)
        h = vs.std(ddof=1) * n ** -0.2 if n > 1 else 0.0
        want = np.exp(-0.5 * ((x[:, None] - vs) / h) ** 2).sum(1) / (n * h * math.sqrt(2 * math.pi)) if h > 0 else np.zeros(101)
        top = 1 / (h * math.sqrt(2 * math.pi)) if h > 0 else 1.0
        assert max(abs(out[k, i] - want[i]) for i in range(101)) <= 1e-6 * top


def test_best_score_prefers_smooth_curves_of_the_same_shape(spark):
    x = np.arange(72) * 5.0 - 177.5
    rng = np.random.default_rng(3)
    shape = np.exp(8 * np.cos(np.radians(3 * x))) / 100 + 1 + 0.05 * rng.normal(size=72)
    rows = [(1, i, float(a), float(p)) for i, (a, p) in enumerate(zip(x, shape / shape.sum() / 5, strict=True))]
    got = C.select_sigma_by_score(spark.createDataFrame(rows, "curve_id long, i long, x double, p double"), [0.2, 1.5, 40.0], ["curve_id"]).collect()
    assert len(got) == 1 and got[0]["sigma"] == 1.5 and 0.5 < got[0]["score"] <= 1.0


def test_sections_over_many_blocks(spark, tmp_path):
    names = ("Masses", "Atoms # molecular", "Bonds")
    rows = {"Masses": ["1 12.0 # C", "2 1.0"], "Atoms": [f"{k} 1 {k % 2 + 1} {k}.5 0.0 -1.0" for k in range(1, 60)], "Bonds": [f"{k} 3 {k} {k + 1}" for k in range(1, 59)]}
    text = "# made by hand\n\n59 atoms\n0.0 10.5 xlo xhi\n-1 9 ylo yhi\n0 1 zlo zhi\n\n" + "".join(f"{n}\n\n" + "\n".join(rows[n.split()[0]]) + "\n\n" for n in names) + "Pair Coeffs\n\n1 0.5 3.0\n"
    for name in ("a.data", "b.data"):
        (tmp_path / name).write_text(text)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "300")
        spark.conf.set(keys[1], "10")
        parts = tables.read_data_file(spark, str(tmp_path))
        atoms = parts["atoms"].where(F.col("file").endswith("b.data")).collect()
        assert sorted((r["id"], r["type"], r["x"]) for r in atoms) == [(k, k % 2 + 1, k + 0.5) for k in range(1, 60)]
        assert parts["bonds"].count() == 2 * 58 and {(r["axis"], r["lo"], r["hi"]) for r in parts["box"].collect()} == {("x", 0.0, 10.5), ("y", -1.0, 9.0), ("z", 0.0, 1.0)}
        assert sorted((r["type"], r["mass"], r["name"]) for r in tables.read_masses(spark, str(tmp_path / "a.data")).collect()) == [(1, 12.0, "C"), (2, 1.0, "")]
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)
