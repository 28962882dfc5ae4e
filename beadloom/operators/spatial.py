"""Cell-list joins in periodic boxes.

Points become cells at least as wide as the cutoff; a pair within the cutoff
then sits in the same or in neighbouring cells, so the range join is an equi
join on (keys, cell) with an exact distance filter. Equal points are merged to
one weighted row first, and cells with many points are salted.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import col, min_image, norm2
from .histograms import bin_index

HOT_CELL = 4096


def lengths(box) -> tuple:
    """Box edges from one value or from three: numbers, or names of columns that hold the edges of each row's frame."""
    three = tuple(box) if isinstance(box, (tuple, list)) else (box,) * 3
    return tuple(v if isinstance(v, str) else float(v) for v in three)


def box_columns(box) -> list[str]:
    """The columns that a box by names needs."""
    return list(dict.fromkeys(v for v in lengths(box) if isinstance(v, str)))


def _axis_grid(x: str, edge, cutoff: float) -> tuple[Column, Column]:
    """(cell of the coordinate, number of cells) of an axis; the number is 0 on an axis without end, where the edge is 0."""
    endless = F.floor(F.col(x) / F.lit(float(cutoff)))
    if not isinstance(edge, str) and edge == 0:
        return endless, F.lit(0).cast("bigint")
    length = F.when(F.col(edge) > 0, F.col(edge)) if isinstance(edge, str) else F.lit(edge)
    n = F.greatest(F.lit(1), F.least(F.floor(length / F.lit(float(cutoff))), F.lit(1 << 20))).cast("bigint")
    frac = F.col(x) / length
    cell = F.least(F.floor((frac - F.floor(frac)) * n.cast("double")), n - 1)
    if not isinstance(edge, str):
        return cell, n
    return F.coalesce(cell, endless), F.when(length.isNotNull(), n).otherwise(0)


def _with_grid(points: DataFrame, box, cutoff: float) -> DataFrame:
    """Points with their cell and the number of cells on each axis."""
    out = []
    for ax, edge in zip("xyz", lengths(box)):
        cell, n = _axis_grid(ax, edge, cutoff)
        out += [cell.alias(f"_c{ax}"), n.alias(f"_n{ax}")]
    return points.select("*", *out)


_GRID = [f"_{k}{ax}" for k in "cn" for ax in "xyz"]


def _cell_code(steps=(0, 0, 0)) -> Column:
    """One number for a cell; 21 bits an axis, of which cells within reach of each other never share all."""
    size = F.lit(1 << 21).cast("bigint")
    parts = []
    for ax, step in zip("xyz", steps):
        cell = F.col(f"_c{ax}") + step
        parts.append(F.pmod(F.when(F.col(f"_n{ax}") > 0, F.pmod(cell, F.col(f"_n{ax}"))).otherwise(cell), size))
    return (parts[0] * size + parts[1]) * size + parts[2]


def with_cell(points: DataFrame, box, cutoff: float) -> DataFrame:
    return _with_grid(points, box, cutoff).withColumn("_cell", _cell_code()).drop(*_GRID)


def with_neighbour_cells(points: DataFrame, box, cutoff: float, half: bool = False) -> DataFrame:
    """One row per neighbouring cell; offsets that meet in a small grid are listed once.

    ``half`` lists, in frames with three cells or more (or no end) on every axis, the own cell and one of each two opposite
    neighbours. ``_own`` is true for rows whose cell may hold both orders of a pair: the own cell there, every cell elsewhere.
    """
    offsets = list(product((-1, 0, 1), repeat=3))
    listed = lambda some: F.array(*[F.struct(*[F.lit(d).alias(f"_d{ax}") for ax, d in zip("xyz", o)]) for o in some])
    wide = F.lit(half)
    for ax in "xyz":
        wide = wide & ((F.col(f"_n{ax}") == 0) | (F.col(f"_n{ax}") >= 3))
    near = _with_grid(points, box, cutoff).withColumn("_wide", wide)
    steps = F.when(F.col("_wide"), listed([o for o in offsets if o >= (0, 0, 0)])).otherwise(listed(offsets))
    near = near.select("*", F.inline(steps))
    once = F.lit(True)  # two cells on an axis: one neighbour; one cell: none
    for ax in "xyz":
        n, d = F.col(f"_n{ax}"), F.col(f"_d{ax}")
        once = once & ((n == 0) | (n >= 3) | (d == 0) | ((n == 2) & (d == 1)))
    own = ~F.col("_wide") | ((F.col("_dx") == 0) & (F.col("_dy") == 0) & (F.col("_dz") == 0))
    cells = near.where(once).withColumn("_cell", _cell_code([F.col(f"_d{ax}") for ax in "xyz"]))
    return (cells.withColumn("_own", own) if half else cells).drop(*_GRID, "_wide", "_dx", "_dy", "_dz")


def _salted(left: DataFrame, right: DataFrame, keys: list[str], tag: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split the left rows of crowded cells and repeat the right rows once per split."""
    crowded = (
        left.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > HOT_CELL)
        .select(*keys, "_cell", F.ceil(F.col("_n") / HOT_CELL).alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    cut = left.join(crowded, [*keys, "_cell"], "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*tag), parts)
    ).drop("_parts")
    repeated = right.join(crowded, [*keys, "_cell"], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    ).drop("_parts")
    return cut, repeated


def _prefixed(points: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    skip = {*keys, "_cell", "_salt", "_own"}
    return points.withColumnsRenamed({c: f"{prefix}{c}" for c in points.columns if c not in skip})


def squared_distance(box, a: str = "l_", b: str = "r_") -> Column:
    edges = [F.col(f"{a}{edge}") if isinstance(edge, str) else edge for edge in lengths(box)]
    return norm2(*[min_image(F.col(f"{b}{ax}") - F.col(f"{a}{ax}"), edge) for ax, edge in zip("xyz", edges)])


def neighbour_join(left: DataFrame, right: DataFrame, keys: list[str], box, cutoff: float, how: str = "inner",
                   condition: Column | None = None, inclusive: bool = False, half: bool = False) -> DataFrame:
    """Pairs within the cutoff as ``l_*`` and ``r_*`` columns plus ``d2``; or a semi join of the left.

    The box is one number, three numbers, or three columns that both sides have and that
    agree within the keys (a box per frame); an edge of 0 means no periodic images.
    With ``half`` (both sides the same points, ``condition`` true for one order of each pair) every pair
    of points meets once, in large grids by cells already.
    """
    lhs = with_cell(left, box, cutoff)
    rhs = with_neighbour_cells(right, box, cutoff, half)
    lhs, rhs = _salted(lhs, rhs, keys, ["x", "y", "z"])
    lhs, rhs = _prefixed(lhs, keys, "l_"), _prefixed(rhs, keys, "r_")
    on = [*keys, "_cell", "_salt"]
    # The work is in the pairs, not in the bytes: keep the partition count whatever the size of the inputs.
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.sparkSession.sparkContext.defaultParallelism)
    lhs, rhs = lhs.repartition(parts, *on), rhs.repartition(parts, *on)
    limit = F.lit(float(cutoff) * float(cutoff))
    d2 = squared_distance(box)
    near = (d2 <= limit) if inclusive else (d2 < limit)
    if condition is not None:
        near = near & (~F.col("_own") | condition if half else condition)
    if how == "left_semi":
        cond = near
        for c in on:
            cond = cond & (F.col(f"_a.{c}") == F.col(f"_b.{c}"))
        return lhs.alias("_a").join(rhs.alias("_b"), cond, "left_semi").drop("_cell", "_salt")
    return lhs.join(rhs, on).where(near).withColumn("d2", d2).drop("_cell", "_salt", "_own")


def weighted_points(points: DataFrame, keys: list[str], box=()) -> DataFrame:
    """Copies of one point merged to a single row with their number ``w``."""
    return points.groupBy(*keys, "type", "x", "y", "z", *box_columns(box) if box else ()).agg(F.count(F.lit(1)).alias("w"))


def candidate_pairs(points: DataFrame, keys: list[str], box, cutoff: float, ends, monomers) -> DataFrame:
    """Number of (end, monomer) pairs closer than the cutoff per key, one column per type pair."""
    merged = weighted_points(points.where(F.col("type").isin([*ends, *monomers])), keys, box)
    pairs = neighbour_join(
        merged.where(F.col("type").isin(list(ends))), merged.where(F.col("type").isin(list(monomers))), keys, box, cutoff
    )
    sums = pairs.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when((F.col("l_type") == a) & (F.col("r_type") == b), F.col("l_w") * F.col("r_w"))), F.lit(0)).alias(f"E{a}{b}")
        for a in ends for b in monomers
    ])
    return points.select(*keys).distinct().join(sums, keys, "left").na.fill(0)


def pair_histogram(points: DataFrame, keys: list[str], box, r_max: float, bins: int) -> DataFrame:
    """Unordered pairs per (keys, t1 <= t2, bin) from 0 to r_max, each pair once.

    Pairs between copies of one point are counted from the number of copies.
    """
    merged = weighted_points(points, keys, box)
    once = F.lit(False)  # (type, x, y, z) of the left before that of the right
    for c in ("z", "y", "x", "type"):
        once = (F.col(f"l_{c}") < F.col(f"r_{c}")) | ((F.col(f"l_{c}") == F.col(f"r_{c}")) & once)
    pairs = neighbour_join(merged, merged, keys, box, r_max, condition=once, inclusive=True, half=True)
    apart = pairs.select(
        *keys, F.least("l_type", "r_type").alias("t1"), F.greatest("l_type", "r_type").alias("t2"),
        bin_index(F.sqrt("d2"), 0.0, r_max, bins).alias("i"), (F.col("l_w") * F.col("r_w")).alias("n"),
    )
    copies = merged.where("w > 1").select(
        *keys, F.col("type").alias("t1"), F.col("type").alias("t2"), F.lit(0).cast("bigint").alias("i"),
        F.expr("w * (w - 1) div 2").alias("n"),
    )
    return apart.unionByName(copies).groupBy(*keys, "t1", "t2", "i").agg(F.sum("n").alias("n"))


def excluded_histogram(points: DataFrame, keys: list[str], id_col: str, exclusions: DataFrame, box, r_max: float,
                       bins: int) -> DataFrame:
    """The same counts for the excluded pairs only, to be taken off ``pair_histogram``.

    Work grows with the bonded pairs, not with the neighbour pairs.
    """
    names = ("type", "x", "y", "z", *box_columns(box))
    base = points.select(*keys, F.col(id_col).alias("_id"), *names)
    lhs = base.withColumnsRenamed({"_id": "lo", **{c: f"l_{c}" for c in names}})
    rhs = base.withColumnsRenamed({"_id": "hi", **{c: f"r_{c}" for c in names}})
    pairs = exclusions.join(lhs, "lo").join(rhs, [*keys, "hi"])
    d = F.sqrt(squared_distance(box))
    return pairs.select(
        *keys, F.least("l_type", "r_type").alias("t1"), F.greatest("l_type", "r_type").alias("t2"),
        bin_index(d, 0.0, r_max, bins).alias("i"),
    ).where("i IS NOT NULL").groupBy(*keys, "t1", "t2", "i").agg(F.count(F.lit(1)).alias("n"))


def radial_distribution(points: DataFrame, keys: list[str], id_col: str, box, r_max: float, bins: int,
                        exclusions: DataFrame | None = None) -> DataFrame:
    """g(r) per unordered type pair over all frames; ordered pairs of one type count twice.

    Exclusions lower the histogram, not the number of pairs it is compared with. The
    volume is the mean over the frames where the box is given by columns.
    """
    hist = pair_histogram(points, keys, box, r_max, bins)
    if exclusions is not None:
        gone = excluded_histogram(points, keys, id_col, exclusions, box, r_max, bins)
        hist = hist.unionByName(gone.withColumn("n", -F.col("n")))
    total = hist.groupBy("t1", "t2", "i").agg(F.sum("n").alias("n"))
    edges = [col(edge) for edge in lengths(box)]
    frames = points.groupBy(*keys).agg(F.max(edges[0] * edges[1] * edges[2]).alias("v"))
    n_frames = frames.agg(F.count(F.lit(1)).alias("f")).scalar()
    mean_volume = frames.agg(F.avg("v").alias("v")).scalar()
    per_type = points.groupBy("type").agg((F.count(F.lit(1)) / n_frames).alias("m"))  # mean census per type
    a = per_type.select(F.col("type").alias("t1"), F.col("m").alias("m1"))
    b = per_type.select(F.col("type").alias("t2"), F.col("m").alias("m2"))
    same = F.col("t1") == F.col("t2")
    width = float(r_max / bins)
    mid = (F.col("i").cast("double") + 0.5) * F.lit(width)
    n_pairs = F.when(same, F.col("m1") * (F.col("m1") - 1)).otherwise(F.col("m1") * F.col("m2"))
    ordered = F.when(same, F.col("n") * 2).otherwise(F.col("n"))
    ideal = F.lit(12.566370614359172) * mid * mid * F.lit(width) * n_pairs / mean_volume
    return total.join(F.broadcast(a), "t1").join(F.broadcast(b), "t2").select(
        "t1", "t2", "i", mid.alias("r"), ordered.alias("pairs"),
        F.when(ideal > 1e-9, ordered / n_frames / ideal).otherwise(0.0).alias("g"),
    )


def reacted_neighbourhood(points: DataFrame, reacted: DataFrame, keys: list[str], box, radius: float) -> DataFrame:
    """Reacted atoms and every atom closer than the radius to one of them."""
    centres = points.join(reacted.select(*keys, "atom_id").distinct(), [*keys, "atom_id"], "left_semi")
    near = neighbour_join(points, centres.drop("atom_id"), keys, box, radius, how="left_semi").select(
        *keys, F.col("l_atom_id").alias("atom_id")
    )
    return near.unionByName(reacted.select(*keys, "atom_id")).distinct()
