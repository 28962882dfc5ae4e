"""Online monitoring as Structured Streaming: counters, detector, evolving mapping, bead frames, histograms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.kernels import image_index, wrapped
from ..operators.coarse import centre_of_mass
from ..operators.graph import unwrap_molecules
from ..session import cut_lineage, scratch_path
from ..sources.dump import landed_atoms


def run_available(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], label: str, checkpoint: str | None = None) -> None:
    """Process what is there and stop; a restart with the same checkpoint continues."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option(
        "checkpointLocation", checkpoint or scratch_path(spark, f"{label}-state"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_totals(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Totals per key so far, for update mode."""
    return counts.groupBy(*keys).agg(F.sum(value).alias("total"), F.max("timestep").alias("timestep"))


def latest(updates: DataFrame, keys: list[str], values: list[str], batch: str = "batch") -> DataFrame:
    """Newest update per key out of an append log of update-mode batches."""
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), batch).alias("_v")).select(*keys, "_v.*")


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch, overwritten on a retry, so a batch counts once."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/b={number}")

    return sink


# --- state per run ---------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: A store is open for every partition that an executor has; unbounded, each of them may hold write buffers of 64 MB beside the heap.
BOUNDS = {"boundedMemoryUsage": "true", "maxMemoryUsageMB": "256"}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of several kinds per key needs this store; queries started inside use it."""
    wanted = {STATE_STORE: ROCKS} | {f"spark.sql.streaming.stateStore.rocksdb.{k}": v for k, v in BOUNDS.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        if k == STATE_STORE or before[k] is None:  # bounds that the cluster has set stay
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


class _RunState(StatefulProcessor):
    """State of a share of a run, dropped once nothing of it has arrived for ``idle_ms`` of ingestion time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def stay(self, rows: pd.DataFrame) -> None:
        """Put off the end of the run."""
        last = int(rows["ingested"].max().timestamp() * 1000) + self.idle_ms
        timers = list(self.handle.listTimers())
        if not timers or max(timers) < last:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last)

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def _per_run(rows: DataFrame, bucket, processor: _RunState, schema: str, delay: str) -> DataFrame:
    keyed = rows.withWatermark("ingested", delay).withColumn("bucket", bucket)
    return keyed.groupBy("run", "bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


# --- bond changes with the previous snapshot as state -------------------------

CHANGE_SCHEMA = "run BIGINT, timestep BIGINT, lo BIGINT, hi BIGINT, bond_type BIGINT, status STRING"
_BOND = ["lo", "hi", "bond_type"]


class _BondMonitor(_RunState):
    """The last snapshot of one bucket of bonds, as a map from slots to the bonds in them; only slots that change are written."""

    def __init__(self, idle_ms: int, slots: int):
        super().__init__(idle_ms)
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bonds = handle.getMapState("bonds", "slot INT", "lo ARRAY<BIGINT>, hi ARRAY<BIGINT>, bond_type ARRAY<BIGINT>")
        self.seen = handle.getValueState("seen", "timestep BIGINT")

    def forget(self) -> None:
        self.bonds.clear()
        self.seen.clear()

    def _slot(self, bonds: np.ndarray) -> np.ndarray:
        lo, hi = (bonds[k].view(np.uint64) for k in (0, 1))
        mixed = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed >> np.uint64(40)) % np.uint64(self.slots)).astype(np.int64)

    def _arrivals(self, rows: Iterator[pd.DataFrame]) -> tuple[list[int], list[list[np.ndarray]]]:
        """Timesteps in order, and for each slot the blocks of its bonds (lo, hi, bond_type, timestep) as they came."""
        steps: set[int] = set()
        blocks: list[list[np.ndarray]] = [[] for _ in range(self.slots)]
        ingested = []
        for some in rows:
            ingested.append(some["ingested"].max())
            some = some.dropna(subset=["timestep"])
            steps.update(some["timestep"].unique().astype(np.int64).tolist())
            some = some[some["lo"] >= 0]  # heartbeat rows have no bond
            block = np.stack([some[c].to_numpy(np.int64) for c in (*_BOND, "timestep")])
            slot = self._slot(block)
            for k in np.unique(slot).tolist():
                blocks[k].append(block[:, slot == k])
        self.stay(pd.DataFrame({"ingested": ingested}))
        return sorted(steps), blocks

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = not self.seen.exists()
        steps, blocks = self._arrivals(rows)
        changes, n_changes = [], 0
        for slot in range(self.slots):  # one after the other: what is compared is a share of the bucket
            value = None if new else self.bonds.getValue((slot,))
            before = stored = np.zeros((3, 0), np.int64) if value is None else _distinct(np.array(value, np.int64).reshape(3, -1))
            arrived = np.concatenate([np.zeros((4, 0), np.int64), *blocks[slot]], axis=1)
            blocks[slot] = []
            for k, step in enumerate(steps):
                now = _distinct(arrived[:3, arrived[3] == step])
                if k or not new:
                    made, gone = _without(now, before), _without(before, now)
                    both = np.concatenate([made, gone], axis=1)
                    changes.append(pd.DataFrame({
                        "run": key[0], "timestep": step, "lo": both[0], "hi": both[1], "bond_type": both[2],
                        "status": np.repeat(np.array(["created", "deleted"], object), [made.shape[1], gone.shape[1]]),
                    }))
                    n_changes += both.shape[1]
                before = now
            if n_changes >= CHANGES_AT_ONCE:
                yield pd.concat(changes, ignore_index=True)
                changes, n_changes = [], 0
            if np.array_equal(stored, before):
                continue
            if before.shape[1]:
                self.bonds.updateValue((slot,), tuple(part.tolist() for part in before))
            else:
                self.bonds.removeKey((slot,))
        if n_changes:
            yield pd.concat(changes, ignore_index=True)
        self.seen.update((steps[-1],))


#: Rows that the detector hands on together, at the least.
CHANGES_AT_ONCE = 50_000


def _distinct(bonds: np.ndarray) -> np.ndarray:
    """Bonds (lo, hi, bond_type) in order of their pair; of those with one pair the first that came."""
    bonds = bonds[:, np.lexsort((bonds[1], bonds[0]))]  # stable
    again = (bonds[0, 1:] == bonds[0, :-1]) & (bonds[1, 1:] == bonds[1, :-1])
    return bonds[:, np.concatenate([np.ones(min(1, bonds.shape[1]), bool), ~again])] if again.any() else bonds


def _without(bonds: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``bonds`` whose pair is not among ``others``; both have a pair once."""
    n = bonds.shape[1]
    lo, hi = (np.concatenate([bonds[k], others[k]]) for k in (0, 1))
    order = np.lexsort((hi, lo))  # stable: of equal pairs that of ``bonds`` comes first
    paired = np.zeros(len(lo), bool)
    paired[:-1] = (lo[order[1:]] == lo[order[:-1]]) & (hi[order[1:]] == hi[order[:-1]])
    alone = np.ones(len(lo), bool)
    alone[order[paired]] = False
    return bonds[:, alone[:n]]


def bond_changes(snapshots: DataFrame, buckets: int = 64, slots: int = 16, idle_ms: int = 6 * 3600 * 1000, delay: str = "1 hour") -> DataFrame:
    """Created and deleted bonds between consecutive snapshots of a stream; start the query inside ``keyed_state``.

    ``snapshots`` is (run, timestep, bond_type, lo, hi, ingested) plus one heartbeat per
    snapshot and bucket (``with_heartbeats``), so that a bucket which lost all its bonds is seen. A snapshot must not be split
    over micro-batches. State is the last snapshot, by run, bucket and slot; that of a run of which nothing arrives for
    ``idle_ms`` of ingestion time is dropped, once the watermark, ``delay`` behind the newest arrival, has passed. What such a run
    sends later starts it anew: its first snapshot gives no changes.
    """
    bucket = F.when(F.col("lo") < 0, F.col("hi")).otherwise(F.pmod(F.xxhash64("lo", "hi"), F.lit(buckets)))
    return _per_run(snapshots, bucket, _BondMonitor(idle_ms, slots), CHANGE_SCHEMA, delay)


def with_heartbeats(snapshot: DataFrame, buckets: int = 64) -> DataFrame:
    """Bonds of snapshots plus a row (lo = -1, hi = bucket) per snapshot and bucket."""
    marks = snapshot.groupBy("run", "timestep").agg(F.max("ingested").alias("ingested")).select(
        "run", "timestep", F.lit(0).cast("bigint").alias("bond_type"), F.lit(-1).cast("bigint").alias("lo"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("hi"), "ingested")
    return snapshot.select("run", "timestep", "bond_type", "lo", "hi", "ingested").unionByName(marks)


#: Frames wanted by one micro-batch that may be sent to every executor (some 50 bytes each); beyond it the planner decides.
BROADCAST_FRAMES = 500_000


def frame_pairs_sink(landed: str, check_step: int, path: str) -> Callable[[DataFrame, int], None]:
    """Per batch of bond changes: the frame ``check_step`` before each changed timestep and the frame at it, written once each.

    Landed frames (run, timestep, and the columns of their atoms) are the buffer, so a restarted job finds the frame before in them,
    whatever batch it came with. Frames that have not landed are left out. Output is (run, event, side, timestep, ...).
    """

    def sink(batch: DataFrame, number: int) -> None:
        events = batch.select("run", F.col("timestep").alias("event")).distinct()
        sides = F.array(
            F.struct(F.lit("before").alias("side"), (F.col("event") - check_step).alias("timestep")), F.struct(F.lit("after").alias("side"), F.col("event").alias("timestep")))
        # A frame is one key of this join, so its atoms stay where they were read and the few rows wanted go to them.
        wanted = cut_lineage(events.select("run", "event", F.inline(sides)))
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_FRAMES else wanted
        frames = batch.sparkSession.read.parquet(landed)
        frames.join(wanted, ["run", "timestep"]).select("run", "event", "side", "timestep", *[c for c in frames.columns if c not in ("run", "timestep")]).write.mode(
            "overwrite").parquet(f"{path}/b={number}")

    return sink


# --- evolving bead types -------------------------------------------------------

RETYPE_SCHEMA = "run BIGINT, bead_id BIGINT, timestep BIGINT, old_type BIGINT, new_type BIGINT"


class _TypeMonitor(_RunState):
    """The type of every bead of one bucket that has reacted."""

    def __init__(self, idle_ms: int, type_map: dict[int, int]):
        super().__init__(idle_ms)
        self.type_map = type_map

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.types = handle.getMapState("types", "bead_id BIGINT", "type BIGINT")

    def forget(self) -> None:
        self.types.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(["bead_id", "timestep"], kind="stable", ignore_index=True)
        self.stay(arrived)
        beads = arrived.drop_duplicates("bead_id")
        held = [self.types.getValue((bead,)) for bead in beads["bead_id"].tolist()]
        current = pd.Series([int(first) if own is None else own[0] for own, first in zip(held, beads["initial_type"], strict=True)], index=beads["bead_id"].to_numpy())
        turn = arrived.groupby("bead_id").cumcount()
        old, new = np.zeros(len(arrived), np.int64), np.zeros(len(arrived), np.int64)
        for k in range(int(turn.max()) + 1):  # the k-th reaction of every bead at once
            at = np.flatnonzero(turn == k)
            ids = arrived["bead_id"].to_numpy()[at]
            old[at] = current[ids]
            new[at] = [self.type_map.get(t, t) for t in old[at].tolist()]
            current[ids] = new[at]
        for bead, kind in current.items():
            self.types.updateValue((int(bead),), (int(kind),))
        yield pd.DataFrame({"run": key[0], "bead_id": arrived["bead_id"], "timestep": arrived["timestep"], "old_type": old, "new_type": new})


def evolving_types(reactions: DataFrame, type_map: dict[int, int], buckets: int = 64, idle_ms: int = 6 * 3600 * 1000, delay: str = "1 hour") -> DataFrame:
    """Type changes of beads through a stream of reactions; each one sees the type the last one left. Start it inside ``keyed_state``.

    ``reactions`` is (run, bead_id, initial_type, timestep, ingested). State is one number per bead that has reacted, by run and bucket
    of beads, and is dropped with its run as that of ``bond_changes``.
    """
    return _per_run(reactions, F.pmod(F.xxhash64("bead_id"), F.lit(buckets)), _TypeMonitor(idle_ms, type_map), RETYPE_SCHEMA, delay)


# --- bead frames and histograms -------------------------------------------------


def bead_frames_sink(bonds: DataFrame, mapping: DataFrame, masses: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """Per batch of dump lines (``dump_stream``): molecules made whole, centres of mass, wrapped into the frame's own box, written."""

    def sink(batch: DataFrame, number: int) -> None:
        edges = [(F.col(f"box.{ax}hi") - F.col(f"box.{ax}lo")).alias(f"l{ax}") for ax in "xyz"]
        frame = ["timestep", *[f"l{ax}" for ax in "xyz"], *[f"o{ax}" for ax in "xyz"]]
        atoms = cut_lineage(landed_atoms(batch).select(
            "timestep", F.col("id").alias("atom_id"), "type", "x", "y", "z", *edges, *[F.col(f"box.{ax}lo").alias(f"o{ax}") for ax in "xyz"]))
        whole = unwrap_molecules(atoms, bonds, ["timestep"], ("lx", "ly", "lz"))
        beads = centre_of_mass(whole, mapping, masses, frame)
        out = beads.select(
            "timestep", "bead_id", "mass", *[wrapped(ax, f"o{ax}", f"l{ax}").alias(ax) for ax in "xyz"], *[image_index(ax, f"o{ax}", f"l{ax}").alias(f"i{ax}") for ax in "xyz"])
        out.write.mode("overwrite").parquet(f"{path}/b={number}")

    return sink


def streaming_histogram(values: DataFrame, keys: list[str], bin_column, finished: DataFrame | None = None) -> DataFrame:
    """Bin counts that grow with every batch; keys already finished are left out."""
    if finished is not None:
        values = values.join(finished, keys, "left_anti")
    return values.groupBy(*keys, bin_column.alias("i")).agg(F.count(F.lit(1)).alias("n"))
