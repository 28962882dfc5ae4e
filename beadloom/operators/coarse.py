"""Coarse-graining: bead tables and centres of mass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import min_image
from ..session import cut_lineage
from .skew import per_group
from .spatial import box_columns, lengths


def bead_info(mapping: DataFrame) -> DataFrame:
    """First molecule, first type and total mass per bead."""
    return mapping.groupBy("bead_id").agg(
        F.min_by("mol_id", "atom_id").alias("mol_id"),
        F.min_by("bead_type", "atom_id").alias("bead_type"),
        F.sum("mass").alias("mass"),
    )


def mass_by_type(beads: DataFrame) -> DataFrame:
    """Mass of the first bead of each type."""
    return beads.groupBy("bead_type").agg(F.min_by("mass", "bead_id").alias("mass"))


def mixed_type_beads(mapping: DataFrame) -> DataFrame:
    """Beads whose atoms do not agree on the bead type."""
    return mapping.groupBy("bead_id").agg(
        F.count_distinct("bead_type").alias("n_types"),
        F.min("bead_type").alias("lo_type"),
        F.max("bead_type").alias("hi_type"),
    ).where("n_types > 1")


def centre_of_mass(atoms: DataFrame, mapping: DataFrame, masses: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """Mass-weighted bead positions from unwrapped coordinates.

    Masses come by atom type (1 where unknown); a bead without mass sits at 0.
    """
    keys = list(frame or [])
    m = F.coalesce(F.col("_m"), F.lit(1.0))
    joined = atoms.join(mapping.select("atom_id", "bead_id"), "atom_id").join(
        masses.select("type", F.col("mass").alias("_m")), "type", "left"
    )
    total = F.sum(m)
    sums = joined.groupBy(*keys, "bead_id").agg(
        total.alias("mass"), *[F.sum(m * F.col(ax)).alias(f"_{ax}") for ax in "xyz"]
    )
    return sums.select(
        *keys, "bead_id", "mass",
        *[F.when(F.col("mass") > 0, F.col(f"_{ax}") / F.col("mass")).otherwise(0.0).alias(ax) for ax in "xyz"],
    )


def periodic_centre_of_mass(atoms: DataFrame, mapping: DataFrame, box, frame: list[str] | None = None) -> DataFrame:
    """Bead positions with members unfolded to the first atom of the bead.

    Masses come from the mapping; the plain mean is taken when they sum to
    nothing. The first atom is found by an aggregate and joined back, so the
    atoms of one bead need not meet in one task.
    """
    keys = list(frame or [])
    joined = cut_lineage(atoms.select(*keys, "atom_id", "x", "y", "z", *box_columns(box)).join(
        mapping.select("atom_id", "bead_id", "mass"), "atom_id"
    ))
    first = joined.groupBy(*keys, "bead_id").agg(
        F.min_by(F.struct("x", "y", "z"), "atom_id").alias("_ref")
    )
    unfolded = per_group(joined, first, [*keys, "bead_id"], stored=True).select(
        *keys, "bead_id", "mass",
        *[min_image(F.col(ax) - F.col(f"_ref.{ax}"), edge).alias(f"_d{ax}") for ax, edge in zip("xyz", lengths(box))],
        *[F.col(f"_ref.{ax}").alias(f"_r{ax}") for ax in "xyz"],
    )
    sums = unfolded.groupBy(*keys, "bead_id").agg(
        F.sum("mass").alias("mass"),
        F.count(F.lit(1)).alias("n_atoms"),
        *[F.min(f"_r{ax}").alias(f"_r{ax}") for ax in "xyz"],
        *[F.sum(F.col("mass") * F.col(f"_d{ax}")).alias(f"_w{ax}") for ax in "xyz"],
        *[F.sum(f"_d{ax}").alias(f"_s{ax}") for ax in "xyz"],
    )
    return sums.select(
        *keys, "bead_id", "mass", "n_atoms",
        *[
            (F.col(f"_r{ax}") + F.when(F.col("mass") > 0, F.col(f"_w{ax}") / F.col("mass"))
             .otherwise(F.col(f"_s{ax}") / F.col("n_atoms"))).alias(ax)
            for ax in "xyz"
        ],
    )


def bead_positions(atoms: DataFrame, mapping: DataFrame) -> DataFrame:
    """Position of the first atom of each bead."""
    joined = atoms.select("atom_id", "x", "y", "z").join(mapping.select("atom_id", "bead_id"), "atom_id")
    return joined.groupBy("bead_id").agg(*[F.min_by(ax, "atom_id").alias(ax) for ax in "xyz"])


def molecule_sizes(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_atoms"))
