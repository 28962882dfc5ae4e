"""Counts per reaction frame: rows are the frames at which something reacted, not a grid of cycles.

Runs are chains of chunks: a trajectory is one run number over its chunks in numeric order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import END_TYPES, MONOMER_TYPES, channel
from ..session import cut_lineage
from . import bonds as B
from .events import pre_event_frames
from .ordered import bucketed_row_number
from .reactivity import CHANNELS, EXPOSURE, census
from .spatial import candidate_pairs

KEYS = ("traj", "chunk", "timestep")


def created_channels(before: DataFrame, after: DataFrame, mapping: DataFrame) -> DataFrame:
    """(traj, chunk, timestep, N11..N22): bonds made at each reaction frame by the bead types before it.

    ``before`` and ``after`` are (traj, chunk, timestep, bond_type, a1, a2), ``mapping`` is (traj, chunk, timestep, bead_id,
    bead_type). Bonds of a bead without a type, and of other type pairs, count nowhere.
    """
    made = B.bond_diff(before, after, KEYS).where("status = 'created'").select(*KEYS, "lo", "hi")
    ends = made.select(*KEYS, "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("bead_id"))
    typed = ends.join(mapping.select(*KEYS, "bead_id", "bead_type"), [*KEYS, "bead_id"])
    side = lambda c: F.max(F.when(F.col("bead_id") == F.col(c), F.col("bead_type")))
    pairs = typed.groupBy(*KEYS, "lo", "hi").agg(side("lo").alias("t1"), side("hi").alias("t2"))
    named = pairs.select(*KEYS, channel("t1", "t2").alias("_ch"))
    return named.groupBy(*KEYS).agg(*[F.count_if(F.col("_ch") == c).alias(f"N{c}") for c in CHANNELS])


def event_frame_counts(reactions: DataFrame, before: DataFrame, after: DataFrame, mapping: DataFrame, beads: DataFrame, box, cutoff: float,
                       check_step: int = 1) -> DataFrame:
    """(traj, chunk, cycle, timestep, n1..n6, E35..E46, N11..N22) for every row of ``reactions`` (traj, chunk, timestep).

    Types and candidate pairs are those of the trajectory frame (``beads``: traj, chunk, timestep, type, x, y, z and the box)
    ``check_step`` before the reaction, in the same chunk: nothing is used up yet there. A reaction without that frame
    fails the query. ``cycle`` numbers the reactions of a trajectory from 1 over its chunks. Repeated reactions are one; no reactions
    give no rows.
    """
    events = cut_lineage(reactions.select(*KEYS).distinct())
    frames = beads.select(*KEYS).distinct()
    wanted = cut_lineage(pre_event_frames(events, frames, check_step, ("traj", "chunk")))
    at = beads.join(wanted.select("traj", "chunk", F.col("frame_ts").alias("timestep")), list(KEYS), "left_semi")
    at = cut_lineage(at.withColumn("timestep", F.col("timestep") + check_step))
    pairs = candidate_pairs(at, list(KEYS), box, cutoff, END_TYPES, MONOMER_TYPES)
    full = wanted.select(*KEYS).join(created_channels(before, after, mapping), list(KEYS), "left").na.fill(0)
    full = full.join(pairs, list(KEYS)).join(census(at, list(KEYS)), list(KEYS))
    numbered = bucketed_row_number(full, ["traj"], F.col("chunk"), ["timestep"], "cycle")
    return numbered.select(
        "traj", "chunk", "cycle", "timestep", *[f"n{k}" for k in range(1, 7)], *EXPOSURE.values(), *[f"N{c}" for c in CHANNELS])
