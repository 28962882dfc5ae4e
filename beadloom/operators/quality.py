"""Data-quality rules and summaries over tables of many runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import col
from ..session import cut_lineage
from .ordered import bucketed_row_number, dense_index
from .skew import lookup


def rule(df: DataFrame, name: str, failed: Column) -> DataFrame:
    """(rule, status, n_failed) for one condition over a table."""
    return df.agg(F.count_if(failed).alias("n_failed")).select(
        F.lit(name).alias("rule"), F.when(F.col("n_failed") > 0, "fail").otherwise("pass").alias("status"), "n_failed"
    )


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def reaction_count_checks(counts: DataFrame, names: list[str], expected_rows) -> DataFrame:
    """Rows against the number of loops, negatives, and the total per reaction."""
    wide = counts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in names], *[F.sum(c).alias(f"sum_{c}") for c in names],
    )
    return wide.select(
        "n_rows", (F.col("n_rows") == expected_rows).alias("rows_ok"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("reaction"), F.col(f"neg_{c}").alias("n_negative"), F.col(f"sum_{c}").alias("total")) for c in names])),
    )


def mapping_coverage(mapping: DataFrame, n_atoms, id_col: str = "atom_id") -> DataFrame:
    """Duplicate ids, ids missing from 1..n and number of beads. Ids beyond 1..n do not count as found."""
    found = mapping.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    inside = F.col(id_col).between(1, col(n_atoms))
    beads = mapping.agg(F.count_distinct("bead_id").alias("b")).scalar()
    return found.agg(
        F.sum(F.col("_n") - 1).alias("n_duplicates"), (col(n_atoms) - F.count_if(inside)).alias("n_missing")
    ).withColumn("n_beads", beads)


def missing_ids(mapping: DataFrame, n_atoms: int, first: int = 10, id_col: str = "atom_id") -> DataFrame:
    """The lowest ids of 1..n without a row."""
    expected = mapping.sparkSession.range(1, n_atoms + 1).withColumnRenamed("id", id_col)
    return expected.join(mapping.select(id_col), id_col, "left_anti").orderBy(id_col).limit(first)


def interned_ids(rows: DataFrame, params: list[str], order: str, name: str) -> DataFrame:
    """Distinct parameter tuples numbered by first use, joined back to the rows."""
    rows = cut_lineage(rows)
    firsts = rows.groupBy(*params).agg(F.min(order).alias("_first"))
    numbered = firsts.join(dense_index(firsts, "_first", name), "_first").drop("_first")
    keyed = numbered.withColumn("_pk", F.struct(*params)).drop(*params)
    return lookup(rows.withColumn("_p", F.struct(*params)), "_p", keyed, "_pk", stored=True).drop("_p")


def inferred_box(atoms: DataFrame, keys: list[str], box_cols=("lx", "ly", "lz"), margin: float = 20.0, least: float = 30.0) -> DataFrame:
    """An all-zero box becomes the coordinate range plus a margin, at least ``least``."""
    ranges = atoms.groupBy(*keys).agg(
        *[F.max(b).alias(b) for b in box_cols], *[(F.max(ax) - F.min(ax)).alias(f"_r{ax}") for ax in "xyz"]
    )
    zero = reduce(lambda a, b: a & b, [F.col(b) == 0 for b in box_cols])
    return ranges.select(*keys, *[
        F.when(zero, F.greatest(F.col(f"_r{ax}") + margin, F.lit(least))).otherwise(F.col(b)).alias(b) for ax, b in zip("xyz", box_cols)
    ])


def out_of_box(atoms: DataFrame, boxes: DataFrame, keys: list[str], box_cols=("lx", "ly", "lz")) -> DataFrame:
    outside = reduce(lambda a, b: a | b, [(F.col(ax) < 0) | (F.col(ax) > F.col(b)) for ax, b in zip("xyz", box_cols)])
    return atoms.join(boxes, keys).groupBy(*keys).agg(F.count_if(outside).alias("n_outside"))


def mass_mismatches(atoms: DataFrame, masses: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    own, given = F.col("mass"), F.col("_m")
    joined = atoms.join(masses.select("type", F.col("mass").alias("_m")), "type")
    return joined.groupBy("type").agg(F.count_if(F.abs(own - given) > tolerance).alias("n_mismatch"), F.count(F.lit(1)).alias("n"))


def missing_parameters(used: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, combo) in the system without a parameter row, each with its number of terms."""
    counts = used.groupBy("kind", "combo").agg(F.count(F.lit(1)).alias("n_terms"))
    return counts.join(known.select("kind", "combo"), ["kind", "combo"], "left_anti")


def config_coverage(sites: DataFrame, ids: DataFrame, params: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per-run rules: site types without an id, ids used twice, parameters out of range."""
    lost = sites.select("run", "site").distinct().join(ids.select("run", "site"), ["run", "site"], "left_anti").select(
        "run", F.lit("site_without_id").alias("rule"), F.col("site").alias("detail")
    )
    twice = ids.groupBy("run", "type_id").agg(F.count_distinct("site").alias("n")).where("n > 1").select(
        "run", F.lit("duplicate_id").alias("rule"), F.col("type_id").cast("string").alias("detail")
    )
    out = params.join(ranges, "name").where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).select(
        "run", F.lit("out_of_range").alias("rule"), F.col("name").alias("detail")
    )
    return lost.unionByName(twice).unionByName(out)


def topology_summary(bonds: DataFrame, angles: DataFrame, dihedrals: DataFrame) -> DataFrame:
    """Terms and distinct excluded pairs per kind."""
    parts = []
    for kind, table, a, b in (("bonds", bonds, "a1", "a2"), ("angles", angles, "b1", "b3"), ("dihedrals", dihedrals, "b1", "b4")):
        pair = F.struct(F.least(a, b), F.greatest(a, b))
        parts.append(table.agg(F.count(F.lit(1)).alias("n_terms"), F.count_distinct(pair).alias("n_excluded")).select(F.lit(kind).alias("kind"), "n_terms", "n_excluded"))
    return report(parts)


def frame_guard(frames: DataFrame, keys: list[str], expected: int) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames")).withColumn("enough", F.col("n_frames") >= expected)


def frame_index(frames: DataFrame, keys: list[str], order: str = "timestep", block: int = 1000000) -> DataFrame:
    """Zero-based frame number per file, in order."""
    numbered = bucketed_row_number(frames, keys, F.floor(F.col(order) / F.lit(block)), [order], "_f")
    return numbered.withColumn("frame_index", F.col("_f") - 1).drop("_f")


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, salts: int = 32) -> DataFrame:
    """First k rows per group: k per salted part of the group, then k of those."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return kept.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).drop("_salt", "_r")
