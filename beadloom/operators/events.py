"""Reaction events: rebuild from snapshots, lookups on the frame axis, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import channel, min_image, norm2, pair_type
from ..session import cut_lineage
from .bonds import bond_diff
from .classify import with_reaction_name
from .spatial import lengths


def rebuild_events(before: DataFrame, after: DataFrame, atoms: DataFrame, mapping_before: DataFrame, mapping_after: DataFrame,
                   reaction_pairs: DataFrame, box, periodic: bool = True) -> DataFrame:
    """Reaction events from bond snapshots: created bonds with types, distance and names.

    ``atoms`` carries (frame, atom_id, type, x, y, z); a mapping may have one row
    per atom, or per (frame, atom). The diff comes first, so only reacting
    frames and atoms of the big tables take part.
    """
    created = cut_lineage(bond_diff(before, after).where("status = 'created'"))
    long = created.select("frame", "lo", "hi", F.posexplode(F.array("lo", "hi")).alias("_side", "atom_id"))
    long = long.join(atoms.select("frame", "atom_id", "type", "x", "y", "z"), ["frame", "atom_id"], "left")
    for mapping, name in ((mapping_before, "bead_before"), (mapping_after, "bead_after")):
        on = [k for k in ("frame", "atom_id") if k in mapping.columns]
        long = long.join(mapping.select(*on, F.col("bead_type").alias(name)), on, "left")
    values = ["type", "x", "y", "z", "bead_before", "bead_after"]
    ends = long.groupBy("frame", "lo", "hi").agg(*[F.max(F.when(F.col("_side") == s, F.col(v))).alias(f"{v}_{s + 1}") for v in values for s in (0, 1)])
    edges = lengths(box)
    deltas = [F.col(f"{ax}_2") - F.col(f"{ax}_1") for ax in "xyz"]
    if periodic:
        deltas = [min_image(d, edge) for d, edge in zip(deltas, edges)]
    named = with_reaction_name(ends, reaction_pairs, "bead_before_1", "bead_before_2")
    return named.select(
        F.col("frame").alias("cycle"), F.col("lo").alias("a1"), F.col("hi").alias("a2"),
        F.col("type_1").alias("t1"), F.col("type_2").alias("t2"),
        "bead_before_1", "bead_before_2", "bead_after_1", "bead_after_2",
        F.round(F.sqrt(norm2(*deltas)), 6).alias("distance"),
        F.col("reaction").alias("reaction_type"), pair_type("bead_before_1", "bead_before_2").alias("pair_type"),
    )


def with_pair_type(events: DataFrame) -> DataFrame:
    """Fill a missing pair type from the two types before the reaction."""
    derived = pair_type("t1", "t2")
    if "pair_type" in events.columns:
        return events.withColumn("pair_type", F.coalesce("pair_type", derived))
    return events.withColumn("pair_type", derived)


def pre_event_frames(events: DataFrame, frames: DataFrame, check_step: int, keys=()) -> DataFrame:
    """Each event with the frame of its own keys (trajectory) ``check_step`` before it; a missing frame fails the query."""
    wanted = events.withColumn("frame_ts", F.col("timestep") - check_step)
    joined = wanted.join(frames.withColumnRenamed("timestep", "frame_ts").withColumn("_hit", F.lit(True)), [*keys, "frame_ts"], "left")
    checked = F.when(F.col("_hit"), F.col("frame_ts")).otherwise(
        F.raise_error(F.concat(F.lit("no frame at timestep "), F.col("frame_ts").cast("string"))).cast("bigint")
    )
    return joined.withColumn("frame_ts", checked).drop("_hit")


def frame_as_of(targets: DataFrame, frames: DataFrame, keys: list[str], block: int = 10000) -> DataFrame:
    """Latest frame at or before each target timestep.

    Timesteps are cut into blocks: the answer lies in the target's own block
    or is the last frame of the nearest earlier block. Only block maxima, few
    rows, go through a window over the whole key, so a long run does not have to fit
    into one task.
    """
    blk = F.floor(F.col("timestep") / F.lit(block))
    f = frames.select(*keys, "timestep").distinct().withColumn("_blk", blk)
    t = targets.withColumn("_blk", blk).withColumn("_row", F.struct(*targets.columns))
    tops = f.groupBy(*keys, "_blk").agg(F.max("timestep").alias("_top"))
    every = tops.unionByName(t.select(*keys, "_blk").distinct().withColumn("_top", F.lit(None).cast("bigint")))
    every = every.groupBy(*keys, "_blk").agg(F.max("_top").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "_blk", F.max("_top").over(earlier).alias("_carry"))
    both = t.select(*keys, "_blk", "timestep", F.lit(1).alias("_t"), "_row").unionByName(
        f.select(*keys, "_blk", "timestep", F.lit(0).alias("_t")).withColumn("_row", F.lit(None).cast(t.schema["_row"].dataType))
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy("timestep", "_t").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_own", F.max(F.when(F.col("_t") == 0, F.col("timestep"))).over(inside)).where("_t = 1")
    return seen.join(carried, [*keys, "_blk"]).select("_row.*", F.coalesce("_own", "_carry").alias("frame_timestep"))


def events_on_grid(grid: DataFrame, counts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Event counts on the cycle grid, zero filled; events beyond the last frame fail the query."""
    flagged = grid.withColumn("_grid", F.lit(True))
    joined = flagged.join(counts, keys, "full_outer")
    guard = F.when(F.col("_grid"), F.lit(0)).otherwise(F.raise_error(F.lit("event beyond the last frame")).cast("int"))
    return joined.select(*keys, *[(F.coalesce(v, F.lit(0)) + guard).alias(v) for v in values])


def channel_counts(events: DataFrame, keys=("cycle",)) -> DataFrame:
    """Events per cycle and channel on the grid 1..last cycle; unclassified events are dropped."""
    others = [k for k in keys if k != "cycle"]
    tagged = events.select(*keys, channel("t1", "t2").alias("_ch"))
    per = tagged.groupBy(*keys).agg(
        *[F.count_if(F.col("_ch") == c).alias(f"N{c}") for c in ("11", "12", "21", "22")]
    )
    if others:
        spans = per.groupBy(*others).agg(F.max("cycle").alias("_last"))
    else:
        spans = per.agg(F.max("cycle").alias("_last"))
    grid = spans.select(*others, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_last"))).alias("cycle"))
    return grid.join(per, list(keys), "left").na.fill(0)


def reaction_shares(events: DataFrame, by: str) -> DataFrame:
    """Count and percentage per value; the window runs over the aggregated rows."""
    counts = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = events.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.select(by, "n", F.round(F.lit(100.0) * F.col("n") / total, 1).alias("pct"))


def type_ratios(events: DataFrame, by: str) -> DataFrame:
    """Ratio of counts for each ordered pair of values; the denominator is at least one."""
    counts = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    all_counts = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("v"), "n"))).alias("a"))
    pairs = all_counts.select(F.posexplode("a").alias("i", "p"), "a").select("i", "p", F.posexplode("a").alias("j", "q"))
    return pairs.where("i < j").select(
        F.col("p.v").alias("num"), F.col("q.v").alias("den"),
        (F.col("p.n") / F.greatest(F.col("q.n"), F.lit(1))).alias("ratio"),
    )


def distance_summary(events: DataFrame, by: str = "reaction_type", value: str = "distance") -> DataFrame:
    v = F.col(value)
    return events.where(v.isNotNull()).groupBy(by).agg(
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
    )
