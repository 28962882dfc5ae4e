"""Texts are rebuilt in parts, and what is kept of units is small and right."""

import tracemalloc

import numpy as np
import pyarrow as pa

from beadloom.llm import pieces
from beadloom.llm import text as X


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_texts_are_rebuilt_in_parts():
    fst = pieces.load()
    text = "the quick brown fox, 123 jumps\n" * 40_000
    ids, offsets = fst.encode(pa.array([text, None, "", "a b"]))
    out, peak = peak_mb(lambda: fst.decode(ids, offsets))
    assert out == [text, "", "", "a b"]
    assert peak < 30 * len(text) / 1e6


def test_kept_units_give_the_same_ids_after_others_and_after_being_forgotten():
    seen = []

    def work_out(data, starts, ends):
        seen.extend(bytes(data[a:b]) for a, b in zip(starts, ends, strict=True))
        ids = [list(data[a:b]) for a, b in zip(starts, ends, strict=True)]
        return np.array([x for own in ids for x in own], np.int64), np.concatenate([[0], np.cumsum([len(own) for own in ids])]).astype(np.int64)

    units = X.Units(limit=40, slice_=2)
    rng = np.random.default_rng(5)
    for _ in range(60):
        words = [bytes(rng.integers(97, 100, rng.integers(1, 5)).astype(np.uint8)) for _ in range(9)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        ids, count = units.spans(data, ends - [len(w) for w in words], ends, work_out)
        assert bytes(ids.astype(np.uint8)) == b"".join(words) and count.tolist() == [len(w) for w in words]
        assert np.all(units.keys[1:] > units.keys[:-1])
    assert len(seen) > len(set(seen)) < 160  # some were worked out anew, and never twice while they were kept
    units = X.Units()
    ids, count = units.spans(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), work_out)
    assert len(ids) == len(count) == 0


def test_the_cache_of_units_holds_little_beside_its_ids():
    units = X.Units()
    n = 300_000
    data = np.frombuffer(b"".join(b"%08d" % k for k in range(n)), np.uint8)
    starts = np.arange(n) * 8
    units.spans(data, starts, starts + 8, lambda d, s, e: (np.zeros(len(s), np.int64), np.arange(len(s) + 1)))
    assert sum(x.nbytes for x in (units.keys, units.size, units.at)) <= 16 * n and units.ids.nbytes <= 8 * n
