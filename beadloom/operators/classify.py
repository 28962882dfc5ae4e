"""Type lookups: reaction names, reaction roles, template variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import col


def reaction_pairs(reactions: DataFrame) -> DataFrame:
    """(name, ord, types) to one name per unordered pair of different types; first name wins."""
    a = reactions.select("name", "ord", F.posexplode("types").alias("pa", "ta"), "types")
    pairs = a.select("name", "ord", "pa", "ta", F.posexplode("types").alias("pb", "tb")).where(
        (F.col("pa") < F.col("pb")) & (F.col("ta") != F.col("tb"))
    )
    return pairs.groupBy(F.least("ta", "tb").alias("lo"), F.greatest("ta", "tb").alias("hi")).agg(
        F.min_by("name", F.struct("ord", "pa", "pb")).alias("reaction")
    )


def with_reaction_name(events: DataFrame, pairs: DataFrame, t1: str = "t1", t2: str = "t2") -> DataFrame:
    named = events.withColumn("_lo", F.least(t1, t2)).withColumn("_hi", F.greatest(t1, t2))
    return named.join(pairs.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), ["_lo", "_hi"], "left").withColumn(
        "reaction", F.coalesce("reaction", F.lit("unknown"))
    ).drop("_lo", "_hi")


def with_roles(bonds: DataFrame, ends, monomers, a="a1", b="a2", ta="t1", tb="t2") -> DataFrame:
    """Bonds between an end and a monomer as (end, monomer), whichever way they are listed."""
    forward = col(ta).isin(list(ends)) & col(tb).isin(list(monomers))
    backward = col(tb).isin(list(ends)) & col(ta).isin(list(monomers))

    def pick(x, y):
        return F.when(forward, col(x)).when(backward, col(y))

    return bonds.where(forward | backward).select(
        "*",
        pick(a, b).alias("end_bead"), pick(b, a).alias("monomer_bead"),
        pick(ta, tb).alias("end_type"), pick(tb, ta).alias("monomer_type"),
    )


def template_variants(signatures: DataFrame) -> DataFrame:
    """A signature with several interior types becomes one signature per type."""
    return signatures.select(
        *[c for c in signatures.columns if c != "interior_types"], F.explode("interior_types").alias("interior")
    )
