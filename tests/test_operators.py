"""Hand-made cases, brute force and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beadloom.functions import kernels as K
from beadloom.operators import bonds as B
from beadloom.operators import curves as C
from beadloom.operators import events, graph, histograms, matching, ordered, quality, reactivity, skew, spatial
from beadloom.sources import dump


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- candidate pairs and g(r) ---------------------------------------------------


def brute_pairs(points, box, cutoff):
    out = {}
    for i, (f, t1, *p) in enumerate(points):
        for g, t2, *q in points[i + 1:]:
            if f != g:
                continue
            d2 = sum((b - a - box * np.rint((b - a) / box)) ** 2 for a, b in zip(p, q))
            key = (f, min(t1, t2), max(t1, t2))
            out.setdefault(key, []).append(math.sqrt(d2))
    return out


def make_points(n, box, copies, seed):
    rnd = random.Random(seed)
    pts = [(rnd.randint(0, 1), rnd.randint(3, 6), *[rnd.random() * box for _ in range(3)]) for _ in range(n)]
    pts += [(0, 5, 1.0, 1.0, 1.0)] * copies  # a group of copies
    pts += [(0, 3, 1.0 + rnd.random(), 1.0, 1.0) for _ in range(copies)]  # a crowded cell
    return pts


@pytest.mark.parametrize("box,cutoff", [(10.0, 2.0), (5.0, 2.4), (4.0, 1.9)])
def test_cell_list_equals_brute_force(spark, monkeypatch, box, cutoff):
    monkeypatch.setattr(spatial, "HOT_CELL", 8)  # so that crowded cells are salted
    pts = make_points(120, box, 30, 1)
    df = spark.createDataFrame(pts, "frame bigint, type bigint, x double, y double, z double")
    want = brute_pairs(pts, box, cutoff)
    got = {r["frame"]: r for r in spatial.candidate_pairs(df, ["frame"], box, cutoff, (3, 4), (5, 6)).collect()}
    for f in (0, 1):
        for a in (3, 4):
            for b in (5, 6):
                assert got[f][f"E{a}{b}"] == sum(d < cutoff for d in want.get((f, a, b), [])), (f, a, b)
    hist = {}
    for r in spatial.pair_histogram(df, ["frame"], box, cutoff, 12).collect():
        hist[(r["frame"], r["t1"], r["t2"], r["i"])] = r["n"]
    expected = {}
    for (f, a, b), ds in want.items():
        for d in ds:
            if d <= cutoff:
                key = (f, a, b, min(int(d / (cutoff / 12)), 11))
                expected[key] = expected.get(key, 0) + 1
    assert hist == expected


def test_pair_across_the_boundary(spark):
    pts = [(0, 3, 0.5, 5.0, 5.0), (0, 5, 9.0, 5.0, 5.0), (0, 4, 5.0, 5.0, 5.0), (0, 6, 6.0, 5.0, 5.0)]
    df = spark.createDataFrame(pts, "frame bigint, type bigint, x double, y double, z double")
    row = spatial.candidate_pairs(df, ["frame"], 10.0, 2.0, (3, 4), (5, 6)).collect()[0]
    assert (row["E35"], row["E36"], row["E45"], row["E46"]) == (1, 0, 0, 1)


def test_a_box_per_frame_equals_brute_force(spark):
    edges = {0: (10.0, 12.0, 9.0), 1: (6.5, 7.0, 20.0), 2: (4.0, 3.0, 5.0)}
    rnd = random.Random(4)
    pts = [(f, rnd.randint(3, 6), *[rnd.random() * e for e in edges[f]]) for f in edges for _ in range(60)]
    df = spark.createDataFrame([(*p, *edges[p[0]]) for p in pts], "frame bigint, type bigint, x double, y double, z double, lx double, ly double, lz double")
    want, hist = {}, {}
    for i, (f, s, *p) in enumerate(pts):
        for g, t, *q in pts[i + 1:]:
            if f == g:
                d = math.sqrt(sum((b - a - e * np.rint((b - a) / e)) ** 2 for a, b, e in zip(p, q, edges[f])))
                lo, hi = sorted((s, t))
                want[(f, lo, hi)] = want.get((f, lo, hi), 0) + (d < 2.0)
                if d <= 2.0:
                    key = (f, lo, hi, min(int(d / 0.25), 7))
                    hist[key] = hist.get(key, 0) + 1
    box = ("lx", "ly", "lz")
    got = {r["frame"]: r for r in spatial.candidate_pairs(df, ["frame"], box, 2.0, (3, 4), (5, 6)).collect()}
    assert all(got[f][f"E{a}{b}"] == want.get((f, a, b), 0) for f in edges for a in (3, 4) for b in (5, 6))
    assert {tuple(r)[:4]: r["n"] for r in spatial.pair_histogram(df, ["frame"], box, 2.0, 8).select("frame", "t1", "t2", "i", "n").collect()} == hist
    one = {tuple(r)[:3]: r["g"] for r in spatial.radial_distribution(df.where("frame = 0").withColumn("id", F.monotonically_increasing_id()), ["frame"], "id", box, 2.0, 8).select("t1", "t2", "i", "g").collect()}
    two = {tuple(r)[:3]: r["g"] for r in spatial.radial_distribution(df.where("frame = 0").withColumn("id", F.monotonically_increasing_id()), ["frame"], "id", edges[0], 2.0, 8).select("t1", "t2", "i", "g").collect()}
    assert one == pytest.approx(two) and one


@pytest.mark.parametrize("box", [0, ("e", "e", "e")])
def test_no_box_means_plain_distances(spark, box):
    rnd = random.Random(6)
    pts = [(0, k, rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.uniform(0, 1)) for k in range(80)]
    df = spark.createDataFrame(pts, "frame bigint, atom_id bigint, x double, y double, z double").withColumn("e", F.lit(0.0))
    got = {r["atom_id"] for r in spatial.reacted_neighbourhood(df, df.where("atom_id < 4"), ["frame"], box, 2.5).collect()}
    assert got == {k for _, k, *p in pts if any(math.dist(p, q[2:]) < 2.5 for q in pts[:4])}


def test_unwrapping_in_the_box_of_each_frame(spark):
    edges = {0: 10.0, 1: 7.0}
    atoms = spark.createDataFrame([(f, k, (0.9 * k) % e, 0.0, 0.0, e) for f, e in edges.items() for k in range(30)], "frame bigint, atom_id bigint, x double, y double, z double, e double")
    bonds = spark.createDataFrame([(k, k + 1) for k in range(29)], "a1 bigint, a2 bigint")
    for r in graph.unwrap_molecules(atoms, bonds, ["frame"], "e").collect():
        assert r["x"] == pytest.approx(0.9 * r["atom_id"])


def test_exclusions_lower_the_histogram_only(spark):
    pts = [(0, k, 1, float(k), 0.0, 0.0) for k in range(1, 5)]
    df = spark.createDataFrame(pts, "frame bigint, id bigint, type bigint, x double, y double, z double")
    excl = spark.createDataFrame([(1, 2)], "lo bigint, hi bigint")
    free = spatial.radial_distribution(df, ["frame"], "id", 20.0, 4.0, 4).where("i = 1").collect()[0]
    cut = spatial.radial_distribution(df, ["frame"], "id", 20.0, 4.0, 4, excl).where("i = 1").collect()[0]
    assert (free["pairs"], cut["pairs"]) == (6, 4)
    assert cut["g"] == pytest.approx(free["g"] * 4 / 6)


# --- graph -----------------------------------------------------------------------


def union_find(edges):
    parent = {}

    def find(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def test_components_with_a_hot_node(spark):
    rnd = random.Random(3)
    edges = [(1000, k) for k in range(60)] + [(2000 + k, 2001 + k) for k in range(25)] + [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(60)]
    edges = [(u, v) for u, v in edges if u != v]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    want = union_find(edges)
    assert {r["n"]: r["label"] for r in graph.min_labels(df).collect()} == want
    flipped = spark.createDataFrame([(v, u) for u, v in reversed(edges)], "u bigint, v bigint")
    assert {r["n"]: r["label"] for r in graph.min_labels(flipped).collect()} == want


def test_unwrap_makes_bonds_short(spark):
    true = [(k, 0.9 * k, 0.3 * k, 0.0) for k in range(40)]
    atoms = spark.createDataFrame([(k, x % 10, y % 10, z) for k, x, y, z in true], "atom_id bigint, x double, y double, z double")
    bonds = spark.createDataFrame([(k, k + 1) for k in range(39)], "a1 bigint, a2 bigint")
    got = {r["atom_id"]: r for r in graph.unwrap_molecules(atoms, bonds, [], 10.0).collect()}
    for k, x, y, _ in true:
        assert got[k]["x"] == pytest.approx(x) and got[k]["y"] == pytest.approx(y)
        assert got[k]["molecule"] == 0


def test_lookup_keeps_every_row_of_a_hot_key(spark):
    fact = spark.createDataFrame([(1, k) for k in range(3000)] + [(k, k) for k in range(2, 900)], "key bigint, v bigint")
    dim = spark.createDataFrame([(k, k * 10) for k in range(1, 500)], "id bigint, w bigint")
    out = skew.lookup(fact, "key", dim, "id")
    assert out.count() == fact.count()
    assert out.where("key = 1 AND w = 10").count() == 3000
    assert out.where("w IS NULL").count() == 400


def test_long_chains_are_traced_to_the_end(spark):
    n = 90
    bonds = spark.createDataFrame([(0, k, k + 1) for k in range(1, n)], "template bigint, a1 bigint, a2 bigint")
    starts, edges = spark.createDataFrame([(0, 1)], "template bigint, bead_id bigint"), spark.createDataFrame([(0, n)], "template bigint, bead_id bigint")
    assert rows(graph.trace_chains(starts, bonds, edges).select("position", "bead_id")) == [(k, k + 1) for k in range(1, n - 1)]


# --- storage ---------------------------------------------------------------------


def test_steps_need_a_shared_folder(spark):
    from beadloom import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


def test_steps_are_removed(spark):
    import os

    from beadloom import session

    df = session.cut_lineage(spark.range(5))
    assert df.count() == 5 and os.listdir(session.job_dir(spark))
    session.drop_steps(spark)
    session.drop_steps(spark)
    assert not os.path.exists(session.job_dir(spark))


# --- bonds -----------------------------------------------------------------------


def test_bond_codes_beyond_double_precision(spark):
    n = 3_000_000_000
    df = spark.createDataFrame([(n - 7, n), (99_800_001, 100_000_000), (1, 2)], "a bigint, b bigint").withColumn("code", K.bond_code("a", "b", n))
    lo, hi = K.decode_bond("code", n)
    assert df.where(lo.eqNullSafe(F.col("a")) & hi.eqNullSafe(F.col("b"))).count() == 3


@pytest.mark.parametrize("last,status", [(6, "ambiguous"), (2, "matched")])
def test_the_whole_chain_is_compared(spark, last, status):
    types = {1: 3, 2: 5, 3: 5, 4: 1, 5: 2, 6: 4}
    after = spark.createDataFrame([(1, 1, 2), (1, 1, 6), (1, 2, 3), (1, 3, 4), (1, 4, 5)], "frame bigint, a1 bigint, a2 bigint")
    new = spark.createDataFrame([(1, 1, 2)], "frame bigint, lo bigint, hi bigint")
    kinds = spark.createDataFrame([(1, b, t) for b, t in types.items()], "frame bigint, bead_id bigint, bead_type bigint")
    sig = spark.createDataFrame(
        [("long", 4, 3, 5, [], [5, 1, last]), ("other", 4, 3, 5, [], [6])],
        "name string, interior bigint, end bigint, monomer bigint, chain_end array<bigint>, chain_mono array<bigint>")
    row = matching.signature_lookup(new, kinds, after, sig).collect()[0]
    assert (row["status"], row["name"]) == (status, "long" if status == "matched" else None)


def test_templates_of_many_beads_get_their_own_numbers(spark):
    mapping = spark.createDataFrame([(a, 1, 1) for a in range(200)], "atom_id bigint, bead_id bigint, bead_type bigint")
    hits = [(m, b, m * 100 + b, 7, False) for m in (0, 1) for b in range(100)]
    df = spark.createDataFrame(hits, "match_id bigint, local_bead bigint, atom_id bigint, post_type bigint, is_edge boolean")
    got = rows(matching.remap_template_matches(mapping, df))
    assert got == [(a, a + 2, 7) for a in range(200)]


def test_a_mapping_per_frame(spark):
    bonds = spark.createDataFrame([(1, 1, 10, 11), (2, 1, 10, 11)], "frame bigint, bond_type bigint, a1 bigint, a2 bigint")
    none = bonds.where("false")
    mapping = spark.createDataFrame([(1, 10, 1, 3), (1, 11, 2, 5), (2, 10, 7, 4), (2, 11, 7, 6)], "frame bigint, atom_id bigint, bead_id bigint, bead_type bigint")
    assert rows(B.atom_bonds_to_bead_bonds(bonds, mapping).select("frame", "b1", "b2")) == [(1, 1, 2)]
    atoms = spark.createDataFrame([(f, a, 1, float(a), 0.0, 0.0) for f in (1, 2) for a in (10, 11)], "frame bigint, atom_id bigint, type bigint, x double, y double, z double")
    names = spark.createDataFrame([(3, 5, "x")], "lo bigint, hi bigint, reaction string")
    got = events.rebuild_events(none, bonds, atoms, mapping, mapping, names, 50.0)
    assert rows(got.select("cycle", "bead_before_1", "bead_before_2")) == [(1, 3, 5), (2, 4, 6)]




def test_bond_diff_and_invariant(spark):
    before = spark.createDataFrame([(0, 1, 1, 2), (0, 2, 3, 4), (0, 1, 5, 6)], "frame int, bond_type bigint, a1 bigint, a2 bigint")
    after = spark.createDataFrame([(0, 1, 2, 1), (0, 3, 3, 4), (0, 9, 50, 51)], "frame int, bond_type bigint, a1 bigint, a2 bigint")
    assert rows(B.bond_diff(before, after)) == [(0, 5, 6, 1, "deleted"), (0, 50, 51, 9, "created")]
    typed = rows(B.bond_diff(before, after, typed=True).select("lo", "hi", "bond_type", "status"))
    assert (3, 4, 2, "deleted") in typed and (3, 4, 3, "created") in typed


def test_unmapped_atom_fails(spark):
    bonds = spark.createDataFrame([(0, 1, 1, 9)], "frame int, bond_type bigint, a1 bigint, a2 bigint")
    mapping = spark.createDataFrame([(1, 1)], "atom_id bigint, bead_id bigint")
    with pytest.raises(Exception, match="unmapped"):
        B.atom_bonds_to_bead_bonds(bonds, mapping).collect()


def test_cross_bead_bonds_merge(spark):
    mapping = spark.createDataFrame([(k, (k - 1) // 10 + 1) for k in range(1, 31)], "atom_id bigint, bead_id bigint")
    bonds = spark.createDataFrame([(0, 1, 10, 11), (0, 1, 9, 12), (0, 1, 1, 2)], "frame int, bond_type bigint, a1 bigint, a2 bigint")
    assert rows(B.atom_bonds_to_bead_bonds(bonds, mapping)) == [(0, 1, 2, 1)]


# --- events, counts, estimates ------------------------------------------------------


def test_zero_filled_cycles(spark):
    ev = spark.createDataFrame([(1, 3, 5), (3, 6, 4), (3, 5, 5)], "cycle bigint, t1 bigint, t2 bigint")
    assert rows(events.channel_counts(ev)) == [(1, 1, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 1)]


def test_event_beyond_grid_fails(spark):
    grid = spark.createDataFrame([(1,)], "cycle bigint")
    counts = spark.createDataFrame([(5, 2)], "cycle bigint, n bigint")
    with pytest.raises(Exception, match="beyond the last frame"):
        events.events_on_grid(grid, counts, ["cycle"], ["n"]).collect()


def test_missing_pre_event_frame_fails(spark):
    ev = spark.createDataFrame([(1, 2000)], "event_id bigint, timestep bigint")
    frames = spark.createDataFrame([(500,)], "timestep bigint")
    with pytest.raises(Exception, match="no frame"):
        events.pre_event_frames(ev, frames, 1000).collect()


def synthetic_counts(spark, r1=2.0, r2=1.0, cycles=4000):
    rng = np.random.default_rng(7)
    out, n5, n6 = [], 40000, 40000
    for c in range(1, cycles + 1):
        e35 = e36 = e45 = e46 = 500
        N11, N12 = rng.binomial(e35, 0.004 * r1), rng.binomial(e36, 0.004)
        N21, N22 = rng.binomial(e45, 0.004), rng.binomial(e46, 0.004 * r2)
        out.append((c, c * 10, 0, 0, 100, 100, int(n5), int(n6), e35, e36, e45, e46, int(N11), int(N12), int(N21), int(N22)))
        n5, n6 = n5 - N11 - N21, n6 - N12 - N22
    cols = "cycle bigint, timestep bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, n5 bigint, n6 bigint, E35 bigint, E36 bigint, E45 bigint, E46 bigint, N11 bigint, N12 bigint, N21 bigint, N22 bigint"
    return spark.createDataFrame(out, cols).withColumn("traj", F.lit(0))


def test_known_ratios_come_back(spark):
    counts = synthetic_counts(spark)
    est = reactivity.point_estimates(counts).collect()[0]
    assert est["r1_cand"] == pytest.approx(2.0, rel=0.1) and est["r2_cand"] == pytest.approx(1.0, rel=0.1)
    win = reactivity.window_estimates(counts, ["traj"], (10,)).agg(F.sum("n_events").alias("n")).collect()[0]["n"]
    assert win == counts.select(F.sum(F.col("N11") + F.col("N12") + F.col("N21") + F.col("N22"))).collect()[0][0]
    # The interval of this draw against an ordinary bootstrap of the same blocks (the truth of 2.0
    # lies just outside of both for r1 here, as it may in one draw of twenty).
    ci = {r["estimate"]: r for r in reactivity.block_bootstrap(counts, ["traj"], 20, 1000, seed=5).collect()}
    table = np.array(counts.orderBy("cycle").select("N11", "N12", "N21", "N22").collect())
    blocks = np.array([b.sum(0) for b in np.array_split(table, 20)])
    sums = blocks[np.random.default_rng(0).integers(0, 20, (4000, 20))].sum(1)
    for name, num, den in (("r1_cand", 0, 1), ("r2_cand", 3, 2)):
        lo, hi = np.percentile(sums[:, num] / sums[:, den], [2.5, 97.5])
        assert ci[name]["lo"] == pytest.approx(lo, rel=0.01) and ci[name]["hi"] == pytest.approx(hi, rel=0.01)
        assert ci[name]["lo"] < est[name] < ci[name]["hi"]


def test_short_trajectories_are_resampled_from_their_own_blocks(spark):
    long, short = synthetic_counts(spark, cycles=400), synthetic_counts(spark, cycles=3).withColumn("traj", F.lit(1))
    got = reactivity.block_bootstrap(long.unionByName(short), ["traj"], 20, 200, seed=5).collect()
    assert all(r["n"] == 200 for r in got) and {r["estimate"] for r in got} >= {"r1_cand", "r2_cand"}


def test_zero_events_give_null(spark):
    one = synthetic_counts(spark, cycles=3).withColumn("N11", F.lit(0)).withColumn("N12", F.lit(0))
    est = reactivity.point_estimates(one).collect()[0]
    assert est["r1_bulk"] is None and est["r1_cand"] is None


def test_composition_fit_recovers(spark):
    r1, r2, f, x, path = 1.8, 0.6, 0.5, 0.0, []
    for target in np.linspace(0.04, 0.8, 20):
        for _ in range(2000):
            h = (target - x) / 2000 if _ == 0 else h
            comp = (r1 * f * f + f * (1 - f)) / (r1 * f * f + 2 * f * (1 - f) + r2 * (1 - f) ** 2)
            f += h * (f - comp) / (1 - x)
            x += h
        x = target
        path.append(("a", float(target), float(f)))
    df = spark.createDataFrame(path, "run string, X_mid double, f1 double")
    fit = reactivity.composition_fit(df, ["run"], F.lit(0.5)).collect()[0]
    assert fit["r1_ml"] == pytest.approx(r1, rel=0.05) and fit["r2_ml"] == pytest.approx(r2, rel=0.05) and fit["identifiable"]


# --- ordered helpers ---------------------------------------------------------------


def test_numbering_and_sums_match_plain_windows(spark):
    rnd = random.Random(5)
    data = [(k % 3 if k % 2 else 0, k, rnd.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(data, "g bigint, o bigint, v bigint")
    num = {(r["g"], r["o"]): r["n"] for r in ordered.bucketed_row_number(df, ["g"], F.floor(F.col("o") / 50), ["o"], "n").collect()}
    cum = {(r["g"], r["o"]): r["v_cum"] for r in ordered.blocked_running_sum(df, ["g"], "o", ["v"], 50).collect()}
    seen, total = {}, {}
    for g, o, v in sorted(data):
        seen[g] = seen.get(g, 0) + 1
        total[g] = total.get(g, 0) + v
        assert num[(g, o)] == seen[g] and cum[(g, o)] == total[g]
    idx = {r["o"]: r["i"] for r in ordered.dense_index(df.where("o % 7 = 0"), "o", "i", buckets=8).collect()}
    assert idx == {o: k + 1 for k, o in enumerate(range(0, 500, 7))}


def test_top_per_group_with_one_big_group(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", k) for k in range(400)], "g string, v bigint")
    got = rows(quality.top_per_group(df, ["g"], [F.desc("v")], 2).select("g", "rank", "v"))
    assert got == [("a", 1, 398), ("a", 2, 397), ("b", 1, 399), ("b", 2, 396)]


# --- curves ----------------------------------------------------------------------


def curve(spark, ys, step=1.0):
    return spark.createDataFrame([(0, k, k * step, float(y)) for k, y in enumerate(ys)], "curve_id bigint, i bigint, x double, p double")


def test_savgol_equals_local_polynomials(spark):
    ys = [math.sin(k / 3.0) + (k % 5) * 0.1 for k in range(40)]
    w, order = 9, 3
    got = C.to_arrays(curve(spark, ys)).select(C.savgol_smooth("ps", w, order).alias("s")).collect()[0]["s"]
    for i in range(40):
        start = min(max(i - w // 2, 0), 40 - w)
        fit = np.polyfit(range(start, start + w), ys[start:start + w], order)
        assert got[i] == pytest.approx(np.polyval(fit, i), abs=1e-8)


def test_gradient_equals_numpy(spark):
    x = [0.0, 1.0, 2.5, 3.0, 5.0, 5.5]
    y = [v ** 2 - v for v in x]
    df = spark.createDataFrame([(0, k, a, b) for k, (a, b) in enumerate(zip(x, y))], "curve_id bigint, i bigint, x double, p double")
    got = [r["g"] for r in df.withColumn("g", C.gradient("p")).orderBy("i").collect()]
    assert got == pytest.approx(list(np.gradient(y, x)))


def test_peak_matching_is_greedy(spark):
    raw = spark.createDataFrame([(0, 1.0, 5.0), (0, 2.0, 4.0), (0, 9.0, 1.0)], "curve_id bigint, x double, height double")
    smooth = spark.createDataFrame([(0, 1.6, 4.5), (0, 3.0, 3.0)], "curve_id bigint, x double, height double")
    got = [(r["raw_x"], r["smooth_x"]) for r in C.match_peaks(raw, smooth, 2.0).orderBy("raw_index").collect()]
    assert got == [(1.0, 1.6), (2.0, 3.0), (9.0, None)]


def test_smoothing_keeps_zero_outside_the_data(spark):
    ys = [0] * 10 + [math.exp(-((k - 15) / 5.0) ** 2) * 0.1 for k in range(30)] + [0] * 10
    out = C.smooth_distributions(curve(spark, ys, 0.1), "bond").orderBy("i").collect()
    assert all(r["p_smooth"] == 0 for r in out[:10]) and all(r["p_smooth"] == 0 for r in out[-10:])
    assert max(abs(r["p_smooth"] - r["p"]) for r in out[15:35]) < 0.01


def test_sweep_picks_a_grid_point(spark):
    ys = [math.exp(-((k - 20) / 6.0) ** 2) * 0.1 + (0.002 if k % 2 else 0) for k in range(40)]
    grid = {"small": [0.5, 0.9], "large": [1.5], "order": [2, 3], "width": [1.0]}
    best = C.sweep_smoothing(curve(spark, ys, 0.1), "bond", 7, grid).collect()
    assert len(best) == 1 and best[0]["small"] in grid["small"] and best[0]["order"] in grid["order"] and 0 < best[0]["score"] <= 1


def test_histogram_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 2, 4, 9)], "v double")
    inside = histograms.histogram(df.withColumn("k", F.lit(1)), ["k"], "v", 0.0, 4.0, 4).orderBy("i").collect()
    assert [r["n"] for r in inside] == [1, 1, 2, 1] and sum(r["density"] for r in inside) == pytest.approx(1.0)
    every = histograms.histogram(df.withColumn("k", F.lit(1)), ["k"], "v", 0.0, 4.0, 4, basis="all").collect()
    assert sum(r["density"] for r in every) == pytest.approx(5 / 6)


def test_mixed_tables_of_one_shape_keep_it(spark):
    from beadloom.operators import fits

    scale = {1: (3.0, 0.2), 2: (3.4, 0.3)}
    rows_ = [(k, i, 0.85 * s + i * 0.02, 4 * e * ((s / (0.85 * s + i * 0.02)) ** 12 - (s / (0.85 * s + i * 0.02)) ** 6)) for k, (s, e) in scale.items() for i in range(900)]
    tables = spark.createDataFrame(rows_, "table_id bigint, i bigint, x double, u double")
    got = fits.mix_tables(tables, spark.createDataFrame([(1, 2)], "a bigint, b bigint")).orderBy("i").collect()
    s, e = 3.2, math.sqrt(0.06)
    assert len(got) == 901 and got[0]["sigma_mix"] == pytest.approx(s, abs=0.01) and got[0]["eps_mix"] == pytest.approx(e, abs=0.001)
    for r in got:
        if r["x"] > 0.97 * s:
            assert r["u"] == pytest.approx(4 * e * ((s / r["x"]) ** 12 - (s / r["x"]) ** 6), abs=0.02)


# --- kernels and scans ----------------------------------------------------------------


def test_half_even_minimum_image(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (-5.0,), (6.0,)], "d double")
    assert [r[0] for r in df.select(K.min_image("d", 10.0)).collect()] == [5.0, -5.0, -5.0, -4.0]


def test_log_gamma(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 2.0, 7.5, 100.0)], "n double")
    assert [r[0] for r in df.select(K.log_gamma("n")).collect()] == pytest.approx([math.lgamma(v) for v in (0.5, 1.0, 2.0, 7.5, 100.0)], abs=1e-9)


FRAME = "ITEM: TIMESTEP\n{ts}\nITEM: NUMBER OF ATOMS\n3\nITEM: BOX BOUNDS {head}\n0 10{tilt}\n0 10{tilt}\n0 10{tilt}\nITEM: ATOMS type id z y x\n5 2 22 21 20\n3 1 12 11 10\n6 {last} 32 31 30\n"


def test_dump_columns_by_name_and_stride(spark, tmp_path):
    text = "".join(FRAME.format(ts=k * 10, head="pp pp pp", tilt="", last=3) for k in range(6))
    (tmp_path / "a.dump").write_text(text)
    got = rows(dump.read_dump(spark, str(tmp_path), stride=2).where("frame = 1").select("timestep", "id", "type", "x", "y", "z"))
    assert got == [(20, 1, 3, 10.0, 11.0, 12.0), (20, 2, 5, 20.0, 21.0, 22.0), (20, 3, 6, 30.0, 31.0, 32.0)]
    assert dump.read_dump(spark, str(tmp_path), max_frames=2).select("timestep").distinct().count() == 2


def test_dump_contracts_fail(spark, tmp_path):
    (tmp_path / "gap.dump").write_text(FRAME.format(ts=0, head="pp pp pp", tilt="", last=7))
    with pytest.raises(Exception, match="not 1..N"):
        dump.checked_frames(dump.read_dump(spark, str(tmp_path)), ["timestep"]).collect()
    (tmp_path / "gap.dump").write_text(FRAME.format(ts=0, head="xy xz yz pp pp pp", tilt=" 0.5", last=3))
    with pytest.raises(Exception, match="triclinic"):
        dump.read_dump(spark, str(tmp_path)).select("box").collect()
