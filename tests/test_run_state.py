"""Streaming state of runs: it lasts over restarts and ends with its run."""

import datetime

from pyspark.sql import functions as F

from beadloom.session import scratch_path
from beadloom.streaming import monitor as S

START = datetime.datetime(2024, 1, 1)
SNAPSHOT = "run long, timestep long, bond_type long, lo long, hi long, ingested timestamp"


class Feed:
    """Landings of one stream, each run to its end by a query of its own, which the next one goes on from."""

    def __init__(self, spark, schema, job):
        self.spark, self.schema, self.job = spark, schema, job
        self.source, self.out, self.state = (scratch_path(spark, k) for k in ("feed", "feed-out", "feed-state"))

    def land(self, rows):
        df = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.source)
        with S.keyed_state(self.spark):
            S.run_available(self.job(S.table_stream(self.spark, self.source, df.schema, 100)), "append", S.append_sink(self.out), "feed", self.state)

    def result(self):
        return self.spark.read.parquet(self.out)


def snapshot(spark, run, hour, bonds):
    at = START + datetime.timedelta(hours=hour)
    rows = [(run, hour, t, lo, hi, at) for lo, hi, t in bonds] or [(run, hour, 0, -1, 0, at)]  # a snapshot without bonds has heartbeats only
    return S.with_heartbeats(spark.createDataFrame(rows, SNAPSHOT), 4).distinct()


def changes(feed):
    return sorted((r["run"], r["timestep"], r["lo"], r["hi"], r["bond_type"], r["status"]) for r in feed.result().collect())


def test_detector_goes_on_after_a_restart_and_forgets_ended_runs(spark):
    feed = Feed(spark, SNAPSHOT, lambda s: S.bond_changes(s, buckets=4, slots=3, idle_ms=3 * 3600 * 1000, delay="1 hour"))
    bonds = [(k, k + 1, k % 3 + 1) for k in range(1, 40)]
    feed.land(snapshot(spark, 1, 0, bonds).unionByName(snapshot(spark, 2, 0, bonds[:5])))
    assert changes(feed) == []
    feed.land(snapshot(spark, 1, 1, bonds[3:] + [(90, 95, 2)]))
    want = [(1, 1, lo, hi, t, "deleted") for lo, hi, t in bonds[:3]] + [(1, 1, 90, 95, 2, "created")]
    assert changes(feed) == sorted(want)
    feed.land(snapshot(spark, 1, 2, []))  # everything goes
    want += [(1, 2, lo, hi, t, "deleted") for lo, hi, t in bonds[3:] + [(90, 95, 2)]]
    assert changes(feed) == sorted(want)
    feed.land(snapshot(spark, 2, 3, bonds[1:6]))  # run 2 was only slow
    want += [(2, 3, *bonds[0], "deleted"), (2, 3, *bonds[5], "created")]
    assert changes(feed) == sorted(want)
    feed.land(snapshot(spark, 2, 20, bonds[1:6]))  # the watermark passes the end of run 1
    feed.land(snapshot(spark, 2, 21, bonds[1:6]))  # and its timers fire
    feed.land(snapshot(spark, 1, 22, bonds[:2]))  # run 1 begins anew: nothing to compare with
    assert changes(feed) == sorted(want)
    feed.land(snapshot(spark, 1, 23, bonds[:1]))
    assert changes(feed) == sorted([*want, (1, 23, *bonds[1], "deleted")])


def test_types_evolve_over_restarts_and_end_with_the_run(spark):
    schema = "run long, bead_id long, initial_type long, timestep long, ingested timestamp"
    feed = Feed(spark, schema, lambda s: S.evolving_types(s, {1: 2, 2: 3, 3: 1}, buckets=2, idle_ms=3600 * 1000, delay="1 hour"))
    row = lambda run, bead, step, hour: (run, bead, 1, step, START + datetime.timedelta(hours=hour))
    feed.land([row(1, 7, 2, 0), row(1, 7, 1, 0), row(1, 8, 1, 0), row(2, 7, 1, 0)])
    feed.land([row(1, 7, 3, 1), row(1, 8, 2, 1)])
    got = {(r["run"], r["bead_id"], r["timestep"]): (r["old_type"], r["new_type"]) for r in feed.result().collect()}
    assert got == {(1, 7, 1): (1, 2), (1, 7, 2): (2, 3), (1, 7, 3): (3, 1), (1, 8, 1): (1, 2), (1, 8, 2): (2, 3), (2, 7, 1): (1, 2)}
    feed.land([row(2, 9, 2, 30)])
    feed.land([row(2, 9, 3, 31)])
    feed.land([row(1, 8, 50, 32)])  # run 1 had ended
    late = feed.result().where(F.col("timestep") == 50).collect()
    assert [(r["old_type"], r["new_type"]) for r in late] == [(1, 2)]
