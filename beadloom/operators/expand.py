"""Table generation: mappings and systems from templates and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bonds import angles_from_bonds, atom_bonds_to_bead_bonds, dihedrals_from_bonds, type_ids
from .coarse import bead_info, periodic_centre_of_mass
from .ordered import blocked_running_sum


def _upto(column):
    return F.sequence(F.lit(1).cast("bigint"), F.col(column).cast("bigint"))


def generate_mapping(specs: DataFrame) -> DataFrame:
    """Site templates times repeats times copies to (bead_id, mol_id, bead_type, aa_id, mass).

    ``specs`` has one row per (spec, config): copies, anchor, repeat, offset and
    ``sites`` ARRAY<STRUCT<start, bead_type, indices, weights>>. Ids run on over
    copies and specs; offsets come from sums over the spec table only.
    """
    n_sites = F.size("sites").cast("bigint")
    inside = Window.partitionBy("spec").orderBy("config").rowsBetween(Window.unboundedPreceding, -1)
    cfg = specs.withColumn("_beads", F.col("repeat") * n_sites)
    cfg = cfg.withColumn("_bead_in", F.coalesce(F.sum("_beads").over(inside), F.lit(0)))
    cfg = cfg.withColumn("_mol_in", F.coalesce(F.sum("repeat").over(inside), F.lit(0)))
    per = specs.groupBy("spec").agg(
        F.max("copies").alias("copies"),
        F.sum(F.col("repeat") * n_sites).alias("n_beads"),
        F.sum("repeat").alias("n_mols"),
        F.max_by(F.col("repeat") * F.col("offset") + F.col("anchor"), "config").alias("n_atoms"),
    )
    totals = per.select(
        "spec", "n_beads", "n_mols", "n_atoms",
        *[(F.col("copies") * F.col(c)).alias(f"t_{c}") for c in ("n_beads", "n_mols", "n_atoms")],
    )
    run = blocked_running_sum(totals, [], "spec", ["t_n_beads", "t_n_mols", "t_n_atoms"])
    base = run.select(
        "spec", "n_beads", "n_mols", "n_atoms",
        *[(F.col(f"t_{c}_cum") - F.col(f"t_{c}")).alias(f"o_{c}") for c in ("n_beads", "n_mols", "n_atoms")],
    )
    rows = cfg.join(base, "spec").select("*", F.explode(_upto("copies")).alias("copy"))
    rows = rows.select("*", F.explode(_upto("repeat")).alias("rep")).select("*", F.posexplode("sites").alias("site_no", "site"))
    copy0, rep0 = F.col("copy") - 1, F.col("rep") - 1
    rows = rows.select(
        (F.col("o_n_beads") + copy0 * F.col("n_beads") + F.col("_bead_in") + rep0 * n_sites + F.col("site_no") + 1).alias("bead_id"),
        (F.col("o_n_mols") + copy0 * F.col("n_mols") + F.col("_mol_in") + F.col("rep")).alias("mol_id"),
        F.col("site.bead_type").alias("bead_type"),
        (F.col("o_n_atoms") + copy0 * F.col("n_atoms") + F.col("anchor") + rep0 * F.col("offset") + F.col("site.start")).alias("_base"),
        F.posexplode("site.indices").alias("_k", "_idx"),
        F.col("site.weights").alias("_w"),
    )
    return rows.select("bead_id", "mol_id", "bead_type", (F.col("_base") + F.col("_idx") + 1).alias("aa_id"), F.get("_w", F.col("_k")).alias("mass"))


def replicate_system(molecules: DataFrame, template_atoms: DataFrame, template_bonds: DataFrame,
                     template_angles: DataFrame | None = None, template_dihedrals: DataFrame | None = None,
                     expected_atoms=None) -> dict[str, DataFrame]:
    """Molecule templates times their counts, with running atom offsets.

    ``molecules`` is (spec, copies); templates are keyed by spec with local ids
    from 1. Missing angles and dihedrals are derived on the templates, before
    replication. A system whose size is not ``expected_atoms`` fails the query.
    """
    sizes = template_atoms.groupBy("spec").agg(F.count(F.lit(1)).alias("n_atoms"))
    spans = molecules.join(sizes, "spec").select("spec", "copies", "n_atoms", (F.col("copies") * F.col("n_atoms")).alias("span"))
    run = blocked_running_sum(spans, [], "spec", ["span"])
    base = run.select("spec", "copies", "n_atoms", (F.col("span_cum") - F.col("span")).alias("base"))
    if expected_atoms is not None:
        total = spans.agg(F.sum("span").alias("t")).scalar()
        ok = F.when(total == expected_atoms, F.col("base")).otherwise(
            F.raise_error(F.lit("atom count differs from the coordinates")).cast("bigint")
        )
        base = base.withColumn("base", ok)
    placed = base.select("spec", "n_atoms", "base", F.explode(_upto("copies")).alias("copy"))
    shift = F.col("base") + (F.col("copy") - 1) * F.col("n_atoms")
    if template_angles is None:
        template_angles = angles_from_bonds(template_bonds, keys=["spec"])
    if template_dihedrals is None:
        template_dihedrals = dihedrals_from_bonds(template_bonds, keys=["spec"])

    def spread(template, ids):
        rest = [c for c in template.columns if c not in ("spec", *ids)]
        return placed.join(template, "spec").select("spec", "copy", *[(shift + F.col(c)).alias(c) for c in ids], *rest)

    return {
        "atoms": spread(template_atoms, ["atom_id"]),
        "bonds": spread(template_bonds, ["a1", "a2"]),
        "angles": spread(template_angles, ["b1", "b2", "b3"]),
        "dihedrals": spread(template_dihedrals, ["b1", "b2", "b3", "b4"]),
    }


def convert_to_beads(atoms: DataFrame, bonds: DataFrame, mapping: DataFrame, box) -> dict[str, DataFrame]:
    """Atoms, bonds and mapping to beads, bead bonds, angles and dihedrals with type ids."""
    info = cut_lineage(bead_info(mapping).select("bead_id", "mol_id", "bead_type"))
    beads = periodic_centre_of_mass(atoms, mapping, box).join(info, "bead_id")
    bead_bonds = cut_lineage(atom_bonds_to_bead_bonds(bonds, mapping, keys=()).select("b1", "b2"))
    as_bonds = bead_bonds.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"))
    return {
        "beads": beads,
        "bonds": type_ids(bead_bonds, ["b1", "b2"], info, "bond"),
        "angles": type_ids(angles_from_bonds(as_bonds), ["b1", "b2", "b3"], info, "angle"),
        "dihedrals": type_ids(dihedrals_from_bonds(as_bonds), ["b1", "b2", "b3", "b4"], info, "dihedral"),
    }
