"""Structural classes of molecules and runs of equal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import blocked_running_sum, dense_index
from .skew import lookup


def molecule_fingerprints(particles: DataFrame, terms: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """(mol_id, fingerprint): equal for molecules with the same types and bonded terms.

    ``particles`` is (id, mol_id, local, type); terms are tables of ids. Each
    member is hashed with its place inside the molecule and the hashes are
    combined by xor under two seeds, plus a count: partial aggregates, where a list of the
    members would have to fit into one task.
    """
    parts = [particles.select("mol_id", F.lit("n").alias("kind"), F.array(F.col("local"), F.col("type")).alias("item"))]
    for k, (table, members) in enumerate(terms):
        out = table.select(*members)
        for m in members:
            names = particles.select(F.col("id").alias(m), F.col("local").alias(f"_l{m}"), F.col("mol_id").alias(f"_m{m}"))
            out = out.join(names, m)
        local = [F.col(f"_l{m}") for m in members]
        item = F.least(F.array(*local), F.array(*reversed(local)))
        parts.append(out.select(F.col(f"_m{members[0]}").alias("mol_id"), F.lit(f"t{k}").alias("kind"), item.alias("item")))
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    h1, h2 = F.xxhash64("kind", "item"), F.xxhash64(F.lit("second"), "item", "kind")
    return items.groupBy("mol_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2")
    ).select("mol_id", F.concat_ws(":", *[F.hex(c) for c in ("n_items", "h1", "h2")]).alias("fingerprint"))


def structure_classes(fingerprints: DataFrame) -> DataFrame:
    """Classes numbered by the first molecule that shows them."""
    fingerprints = cut_lineage(fingerprints)
    firsts = fingerprints.groupBy("fingerprint").agg(F.min("mol_id").alias("first_mol"))
    numbers = dense_index(firsts, "first_mol", "class_id")
    named = firsts.join(numbers, "first_mol").select(F.col("fingerprint").alias("_fp"), "first_mol", "class_id")
    return lookup(fingerprints, "fingerprint", named, "_fp", stored=True)


def equal_runs(classes: DataFrame, order: str = "mol_id", value: str = "class_id") -> DataFrame:
    """Consecutive molecules of one class as one run with a count.

    Neighbours meet by an equi join on the rank, so no window covers all molecules.
    """
    classes = cut_lineage(classes.select(order, value))
    ranked = classes.join(dense_index(classes, order, "_rank"), order)
    previous = ranked.select((F.col("_rank") + 1).alias("_rank"), F.col(value).alias("_prev"))
    flagged = ranked.join(previous, "_rank", "left").withColumn(
        "_new", F.when(F.col("_prev").eqNullSafe(F.col(value)), 0).otherwise(1)
    )
    numbered = blocked_running_sum(flagged, [], "_rank", ["_new"])
    return numbered.groupBy(F.col("_new_cum").alias("run")).agg(
        F.max(value).alias(value), F.count(F.lit(1)).alias("n_molecules"),
        F.min(order).alias("first_mol"), F.max(order).alias("last_mol"),
    )
