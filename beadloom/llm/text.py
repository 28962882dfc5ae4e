"""Vectorised kernels on Arrow text batches: words, word hashes, n-gram hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D. All hashes are 64 bit and
depend only on the bytes, so they agree between executors and runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
LONG_WORD = 512
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_C1, _C2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers in which every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x *= _C1
    x ^= x >> _U(27)
    x *= _C2
    x ^= x >> _U(31)
    return x


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold at most ``limit`` bytes, or one document."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
        del batch  # else two of them are held while the next is read


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and the n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n + 1 values)."""
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = ~SPACE[data]
    first, last = ink[1:-1] & ~ink[:-2], ink[1:-1] & ~ink[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = ink[1:-1][cut]
    last[cut - 1] = ink[1:-1][cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) + _GOLD)
    h = mix(h ^ (eight[starts] & _HEAD[np.minimum(length, 8)]))
    at = np.flatnonzero((length > 8) & (length <= LONG_WORD))
    done = 8
    while len(at):
        rest = length[at] - done
        h[at] = mix(h[at] * _GOLD ^ (eight[starts[at] + done] & _HEAD[np.minimum(rest, 8)]))
        done += 8
        at = at[rest > 8]
    for k in np.flatnonzero(length > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words from each position on (len - size + 1 values), by doubling."""
    out, have = None, 0
    power, span = words, 1
    left = size
    while True:
        if left & 1:
            if out is None:
                out = power
            else:
                n = len(words) - have - span + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = mix(out[:n] * _GOLD + power[have : have + n])
            have += span
        left >>= 1
        if not left:
            break
        n = len(words) - 2 * span + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        power = mix(power[:n] * _GOLD + power[span : span + n] + _U(span))
        span *= 2
    n = max(0, len(words) - size + 1)
    return mix(out[:n] + _U(size))


def expand(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Units:
    """Ids of byte spans, worked out once for each distinct span and kept for later batches, up to a number of ids."""

    def __init__(self, limit: int = 2_000_000, slice_: int = 16_384):
        self.limit, self.slice = limit, slice_
        self._forget()

    def _forget(self) -> None:
        self.keys, self.size, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _keep(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            room = np.zeros(max(self.used + len(ids), len(self.ids) * 3 // 2), np.int32)
            room[: self.used] = self.ids[: self.used]
            self.ids = room
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, work_out) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans one after the other, and how many each has.

        ``work_out(data, starts, ends)`` gives the ids of distinct spans and their n + 1 offsets.
        """
        hashes, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if self.used > self.limit:
            self._forget()
        place = np.searchsorted(self.keys, hashes)
        fresh = np.arange(len(hashes))
        if len(self.keys):
            fresh = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != hashes)
        if len(fresh):
            turn = np.argsort((ends - starts)[first[fresh]], kind="stable")
            size, at = np.zeros(len(fresh), np.int32), np.zeros(len(fresh), np.int32)
            for part in np.array_split(turn, len(fresh) // self.slice + 1):
                own = first[fresh[part]]
                ids, offsets = work_out(data, starts[own], ends[own])
                size[part], at[part] = np.diff(offsets), self.used + offsets[:-1]
                self._keep(ids)
            place = place[fresh]  # both sides are in order, so the new keys need no sort
            self.keys = np.insert(self.keys, place, hashes[fresh])
            self.size, self.at = np.insert(self.size, place, size), np.insert(self.at, place, at)
        unit = np.searchsorted(self.keys, hashes)[inverse]
        count = self.size[unit].astype(np.int64)
        where = np.repeat(self.at[unit] - (np.cumsum(count) - count), count)
        where += np.arange(len(where))
        return self.ids[where], count
