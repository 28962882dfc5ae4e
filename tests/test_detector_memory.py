"""The bond detector compares a bucket slot by slot."""

import tracemalloc

import numpy as np
import pandas as pd

from beadloom.streaming.monitor import _BondMonitor


class Handle:
    """State of one group in memory."""

    def __init__(self):
        self.timers, self.states = [], {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Map())

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Value())

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value


class Map(dict):
    def iterator(self):
        return iter([(k, self.getValue(k)) for k in self])

    def getValue(self, key):  # noqa: N802
        return None if key not in self else tuple(part.tolist() for part in self[key])

    def updateValue(self, key, value):  # noqa: N802
        self[key] = [np.array(part, np.int64) for part in value]

    def removeKey(self, key):  # noqa: N802
        del self[key]


def rows(step, lo, hi, kind):
    at = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=step)
    bonds = pd.DataFrame({"run": 1, "timestep": step, "bond_type": kind, "lo": lo, "hi": hi, "ingested": at})
    beat = pd.DataFrame({"run": [1], "timestep": [step], "bond_type": [0], "lo": [-1], "hi": [0], "ingested": [at]})
    return pd.concat([bonds, beat], ignore_index=True)


def batches(frames, size=10_000):
    whole = pd.concat(frames, ignore_index=True)
    return iter([whole.iloc[k : k + size].reset_index(drop=True) for k in range(0, len(whole), size)])


def run(monitor, frames):
    return [tuple(r) for part in monitor.handleInputRows((1, 0), batches(frames), None) for r in part.itertuples(index=False)]


def test_changes_are_those_of_the_whole_snapshots():
    rng = np.random.default_rng(3)
    handle = Handle()
    monitor = _BondMonitor(1000, 16)
    monitor.init(handle)
    seen, last = [], None
    for landing in range(3):
        frames, want = [], []
        for step in (2 * landing, 2 * landing + 1):
            n = 0 if step == 3 else 300
            lo = rng.integers(0, 60, n) * 2**40
            hi, kind = lo + rng.integers(1, 4, n), rng.integers(1, 4, n)
            now = {}
            for pair, k in zip(zip(lo.tolist(), hi.tolist()), kind.tolist()):
                now.setdefault(pair, k)
            if last is not None:
                want += [(1, step, *p, k, "created") for p, k in now.items() if p not in last]
                want += [(1, step, *p, k, "deleted") for p, k in last.items() if p not in now]
            last = now
            frames.append(rows(step, lo, hi, kind))
        got = run(monitor, frames[::-1])
        assert sorted(got) == sorted(want)
        seen += got
    assert len(seen) > 100
    kept = {(a, b): k for lo, hi, kind in monitor.bonds.values() for a, b, k in zip(lo.tolist(), hi.tolist(), kind.tolist())}
    assert kept == last


def test_memory_is_a_small_multiple_of_the_bonds():
    handle = Handle()
    monitor = _BondMonitor(1000, 16)
    monitor.init(handle)
    n = 200_000
    lo = np.arange(n) * 7
    landing = lambda t: [rows(s, lo[(lo + s) % 5 > 0], lo[(lo + s) % 5 > 0] + 1, 1) for s in (t, t + 1)]
    assert sum(len(p) for p in monitor.handleInputRows((1, 0), batches(landing(0)), None)) == n // 5 * 2
    frames = batches(landing(2))
    tracemalloc.start()
    made = sum(len(p) for p in monitor.handleInputRows((1, 0), frames, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == n // 5 * 4
    assert peak < 2 * n * 8 * 10  # ten numbers for each of the rows that arrive; they have six
