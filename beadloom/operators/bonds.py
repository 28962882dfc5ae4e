"""Bond tables: diffs, mapping to beads, derived terms, exclusions.

Diffs union both sides with a flag and aggregate once: one shuffle with
map-side combine instead of a full outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import canonical_combo, lo_hi
from ..session import shuffled, spread


def _sides(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("_in", F.lit(0)).unionByName(after.withColumn("_in", F.lit(1)))


def _flags() -> list:
    return [F.max(F.col("_in") == 0).alias("_b"), F.max(F.col("_in") == 1).alias("_a")]


def bond_diff(before: DataFrame, after: DataFrame, keys=("frame",), typed: bool = False) -> DataFrame:
    """Created and deleted bonds per snapshot, keyed by the unordered pair.

    The type comes from the side the bond was found in; with ``typed`` it is
    part of the key, so a retyped bond is deleted and created.
    """
    group = [*keys, "lo", "hi"] + (["bond_type"] if typed else [])
    both = _sides(before, after).select(*keys, "bond_type", "_in", *lo_hi())
    aggs = _flags() + ([] if typed else [F.min("bond_type").alias("bond_type")])
    out = both.groupBy(*group).agg(*aggs).where(F.col("_a") != F.col("_b"))
    return out.select(
        *keys, "lo", "hi", "bond_type", F.when(F.col("_a"), F.lit("created")).otherwise(F.lit("deleted")).alias("status")
    )


def raw_new_bonds(before: DataFrame, after: DataFrame, keys=("frame",)) -> DataFrame:
    """after minus before on pairs as listed, put in order afterwards."""
    both = _sides(before, after).groupBy(*keys, "a1", "a2").agg(*_flags()).where("_a AND NOT _b")
    return both.select(*keys, *lo_hi()).distinct()


def changed_atoms(diff: DataFrame, keys=("frame",)) -> DataFrame:
    return diff.select(*keys, F.explode(F.array("lo", "hi")).alias("atom_id")).distinct()


def update_bond_set(existing: DataFrame, deleted: DataFrame, new: DataFrame) -> DataFrame:
    """(existing minus deleted) plus new, on whole records, without duplicates."""
    cols = existing.columns
    tagged = (
        existing.withColumn("_s", F.lit(0))
        .unionByName(deleted.select(cols).withColumn("_s", F.lit(1)))
        .unionByName(new.select(cols).withColumn("_s", F.lit(2)))
    )
    seen = tagged.groupBy(*cols).agg(*[F.max(F.col("_s") == k).alias(f"_k{k}") for k in (0, 1, 2)])
    return seen.where("_k2 OR (_k0 AND NOT _k1)").select(cols)


def atom_bonds_to_bead_bonds(bonds: DataFrame, mapping: DataFrame, keys=("frame",), default_type: int = 1) -> DataFrame:
    """Bonds between different beads; an atom without a bead fails the query.

    The mapping has one row per atom, or per atom and the ``keys`` it also carries (a mapping per frame).
    Both lookups shuffle the mapping by atom id, and Spark reuses that exchange.
    """
    own = [k for k in keys if k in mapping.columns]
    beads = mapping.select(*own, "atom_id", "bead_id")

    def bead(c):
        return F.when(F.col(c).isNull() | (F.col(c) == 0), F.raise_error(F.lit("bond to an unmapped atom")).cast("bigint")).otherwise(F.col(c))

    first = bonds.join(beads.withColumnsRenamed({"atom_id": "a1", "bead_id": "_b1"}), [*own, "a1"], "left")
    both = first.join(beads.withColumnsRenamed({"atom_id": "a2", "bead_id": "_b2"}), [*own, "a2"], "left")
    pairs = both.select(*keys, bead("_b1").alias("_p"), bead("_b2").alias("_q")).where("_p <> _q")
    named = pairs.select(*keys, F.least("_p", "_q").alias("b1"), F.greatest("_p", "_q").alias("b2"))
    return spread(named, *keys, "b1", "b2").distinct().withColumn("bond_type", F.lit(default_type).cast("bigint"))


def unmapped_atoms(bonds: DataFrame, mapping: DataFrame, first: int = 10) -> DataFrame:
    """The lowest unmapped atoms of a bond table, each with the total number of them."""
    used = bonds.select(F.explode(F.array("a1", "a2")).alias("atom_id")).distinct()
    missing = used.join(mapping.where("bead_id <> 0").select("atom_id"), "atom_id", "left_anti")
    total = missing.agg(F.count(F.lit(1)).alias("n")).scalar()
    return missing.orderBy("atom_id").limit(first).withColumn("n_unmapped", total)


def cross_molecule_bonds(bonds: DataFrame, beads: DataFrame) -> DataFrame:
    """Bead bonds whose ends belong to different molecules."""
    mol = beads.select("bead_id", "mol_id").distinct()
    left = mol.withColumnsRenamed({"bead_id": "b1", "mol_id": "mol1"})
    right = mol.withColumnsRenamed({"bead_id": "b2", "mol_id": "mol2"})
    return bonds.join(left, "b1").join(right, "b2").where(~F.col("mol1").eqNullSafe(F.col("mol2")))


def both_ways(bonds: DataFrame, keys=()) -> DataFrame:
    """Both directions of every bond, as often as it is listed."""
    both = F.array(
        F.struct(F.col("a1").alias("node"), F.col("a2").alias("neighbour")),
        F.struct(F.col("a2").alias("node"), F.col("a1").alias("neighbour")),
    )
    return bonds.select(*keys, F.inline(both))


def adjacency(bonds: DataFrame, keys=()) -> DataFrame:
    """Both directions of every bond, without duplicates."""
    return both_ways(bonds, keys).distinct()


def angles_from_bonds(bonds: DataFrame, keys=()) -> DataFrame:
    """One angle per unordered pair of neighbours of a centre: (b1 < b3, centre b2).

    The result is quadratic in the bonds of one centre by definition; chemistry
    bounds that number, and the join spreads over tasks by AQE where it is not.
    """
    sym = adjacency(bonds, keys)
    left = sym.select(*keys, F.col("node").alias("b2"), F.col("neighbour").alias("b1"))
    right = sym.select(*keys, F.col("node").alias("b2"), F.col("neighbour").alias("b3"))
    return left.join(right, [*keys, "b2"]).where("b1 < b3").select(*keys, "b1", "b2", "b3")


def dihedrals_from_bonds(bonds: DataFrame, keys=()) -> DataFrame:
    """Paths b1-b2-b3-b4 over each bond (b2, b3), listed with b1 < b4."""
    sym = adjacency(bonds, keys)
    middle = sym.where("node < neighbour").select(*keys, F.col("node").alias("m"), F.col("neighbour").alias("n"))
    left = sym.select(*keys, F.col("node").alias("m"), F.col("neighbour").alias("l"))
    right = sym.select(*keys, F.col("node").alias("n"), F.col("neighbour").alias("r"))
    paths = middle.join(left, [*keys, "m"]).where("l <> n").join(right, [*keys, "n"]).where("r <> m AND l <> r")
    flip = F.col("l") > F.col("r")

    def pick(a, b, name):
        return F.when(flip, F.col(b)).otherwise(F.col(a)).alias(name)

    return paths.select(
        *keys, pick("l", "r", "b1"), pick("m", "n", "b2"), pick("n", "m", "b3"), pick("r", "l", "b4")
    ).distinct()


def exclusion_pairs(bonds=None, angles=None, dihedrals=None) -> DataFrame:
    """Unordered 1-2, 1-3 and 1-4 pairs of the tables given."""
    parts = []
    if bonds is not None:
        parts.append(bonds.select(*lo_hi("a1", "a2")))
    if angles is not None:
        parts.append(angles.select(*lo_hi("b1", "b3")))
    if dihedrals is not None:
        parts.append(dihedrals.select(*lo_hi("b1", "b4")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def with_excluded(points: DataFrame, exclusions: DataFrame, id_col: str) -> DataFrame:
    """Points with the ids that they are excluded with (null: none), of pairs (lo, hi) in either order.

    A point has as many as its bonds, angles and dihedrals make; all neighbour pairs would have to be shuffled to meet the list instead.
    """
    ways = exclusions.select(F.col("lo").alias(id_col), F.col("hi").alias("_to")).unionByName(exclusions.select(F.col("hi").alias(id_col), F.col("lo").alias("_to")))
    return points.join(shuffled(ways.groupBy(id_col).agg(F.collect_set("_to").alias("excluded"))), id_col, "left")


def drop_excluded(pairs: DataFrame, excluded: str, other: str) -> DataFrame:
    """Pairs without those whose ``other`` id is in the list ``excluded``."""
    return pairs.where(~F.coalesce(F.array_contains(excluded, F.col(other)), F.lit(False)))


def type_ids(terms: DataFrame, members: list[str], types: DataFrame, kind: str, presets: DataFrame | None = None,
             order: list[str] | None = None) -> DataFrame:
    """Type id per topology term from its canonical type combination.

    Preset ids win; other combinations are numbered after them by first
    appearance. The window runs over distinct combinations only, whose number
    the type vocabulary bounds.
    """
    out = terms
    for k, m in enumerate(members):
        out = out.join(types.select(F.col("bead_id").alias(m), F.col("bead_type").alias(f"_t{k}")), m)
    combo = F.array_join(canonical_combo(kind, [f"_t{k}" for k in range(len(members))]).cast("array<string>"), "-")
    out = out.select(*terms.columns, combo.alias("combo"))
    combos = out.groupBy("combo").agg(F.min(F.struct(*(order or members))).alias("_first"))
    if presets is None:
        combos = combos.withColumn("_preset", F.lit(None).cast("bigint"))
        base = F.lit(0)
    else:
        combos = combos.join(presets.select("combo", F.col("type_id").alias("_preset")), "combo", "left")
        base = F.coalesce(presets.agg(F.max("type_id").alias("m")).scalar(), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.col("_preset").isNull()).orderBy("_first"))
    ids = combos.select("combo", F.coalesce("_preset", base + rank).cast("bigint").alias("type_id"))
    return out.join(F.broadcast(ids), "combo")


def ordered_type_ids(bonds: DataFrame, types: DataFrame, members=("a1", "a2")) -> DataFrame:
    """(t1, t2) and (t2, t1) kept apart, numbered by first appearance."""
    out = bonds
    for k, m in enumerate(members):
        out = out.join(types.select(F.col("bead_id").alias(m), F.col("bead_type").alias(f"t{k + 1}")), m)
    firsts = out.groupBy("t1", "t2").agg(F.min(F.struct(*members)).alias("_first"))
    ids = firsts.select("t1", "t2", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_first")).alias("type_id"))
    return out.join(F.broadcast(ids), ["t1", "t2"])
