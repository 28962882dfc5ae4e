"""Periodic runs of words by recompression.

The words of all texts of a chunk stand in one sequence of symbols, with a symbol of its own after each text. A
run-length grammar is built over it by recompression: rounds of block compression (every maximal row of one symbol becomes
one symbol) and pair compression (a hash deals the symbols into a left and a right half; every left symbol
followed by a right one becomes one symbol with it) alternate until a single symbol is left. What happens at a place
depends on its neighbours only, so equal passages are compressed alike up to their edges.

That answers longest common extensions of two places, to the right and to the left, for many pairs at once: a pair
climbs while both places begin a symbol of the next level, after at most one step on the level it is on; where
the next symbols differ it descends again, with at most one step a level, down to the word that differs.

Candidates come from a harmonic grid: a stretch of period q and at least 4q words holds four neighbouring multiples of
q, with one word at all of them. For each q the sequence is looked at in steps of q only, n/1 + n/2 + ... places in all.
Exact extensions of a candidate give its whole stretch; further candidates inside it are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

SHORTEST = 6
REPEATS = 4
QUERIES = 1 << 18
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """The levels of a sequence under recompression.

    ``seq[h]`` are the symbols of level h, ``start[h]`` says of each place of it (its end included) whether a symbol of level h + 1
    begins there, ``rank[h]`` is the number of such places before it, ``down[h]`` are the places where the symbols
    of level h + 1 begin, its length at the end. Even levels compress blocks, odd ones pairs.
    """

    def __init__(self, symbols: np.ndarray):
        self.seq, self.start, self.rank, self.down = [symbols.astype(np.int64)], [], [], []
        while len(self.seq[-1]) > 1:
            seq = self.seq[-1]
            head = np.ones(len(seq) + 1, bool)
            if len(self.seq) % 2:
                head[1:-1] = seq[1:] != seq[:-1]
            else:
                right = (X.mix(seq.astype(np.uint64) + np.uint64(len(self.seq) << 40)) & np.uint64(1)).astype(bool)
                head[1:-1] = right[:-1] | ~right[1:]
            down = np.flatnonzero(head)
            size = np.diff(down)
            # a symbol is named by its first part with the length of the block, or with the second part of the pair
            tail = size if len(self.seq) % 2 else np.where(size == 2, seq[down[1:] - 1] + 1, 0)
            code = seq[down[:-1]] * (int(tail.max()) + 1) + tail
            self.start.append(head)
            self.rank.append((np.cumsum(head) - head).astype(np.int32))
            self.down.append(down.astype(np.int32))
            self.seq.append(np.unique(code, return_inverse=True)[1].astype(np.int64))

    def _step(self, h: int, i: np.ndarray, j: np.ndarray, to_right: bool) -> tuple[np.ndarray, np.ndarray]:
        """How far both places move together on level h, inside a block or by one symbol, and whether they can go on after it."""
        seq, n = self.seq[h], len(self.seq[h])
        a, b = (i, j) if to_right else (i - 1, j - 1)
        good = (np.maximum(a, b) < n) & (np.minimum(a, b) >= 0)
        a, b = np.where(good, a, 0), np.where(good, b, 0)
        good &= seq[a] == seq[b]
        if h % 2:
            return good.astype(np.int64), good
        rank, down, start = self.rank[h], self.down[h], self.start[h]
        left = [rank[x] - ~start[x] for x in (a, b)]  # the block that holds a place
        rest = [(down[k + 1] - x) if to_right else (x + 1 - down[k]) for k, x in zip(left, (a, b), strict=True)]
        return np.where(good, np.minimum(*rest), 0), good & (rest[0] == rest[1])

    def extension(self, i: np.ndarray, j: np.ndarray, to_right: bool) -> np.ndarray:
        """Number of equal symbols from the places i and j on (i != j), or before them."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        first, sign = i.copy(), 1 if to_right else -1
        stopped = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for h in range(len(self.start)):
            a, b = i[live], j[live]
            inside = np.flatnonzero(~(self.start[h][a] & self.start[h][b]))
            more, going = self._step(h, a[inside], b[inside], to_right)
            a[inside] += sign * more
            b[inside] += sign * more
            keep = np.ones(len(live), bool)
            keep[inside] = going
            i[live[~keep]], j[live[~keep]], stopped[live[~keep]] = a[~keep], b[~keep], h
            live, a, b = live[keep], a[keep], b[keep]
            i[live], j[live], stopped[live] = self.rank[h][a], self.rank[h][b], h + 1
            if not len(live):
                break
        for h in range(int(stopped.max(initial=0)) - 1, -1, -1):
            at = np.flatnonzero(stopped > h)
            a, b = self.down[h][i[at]].astype(np.int64), self.down[h][j[at]].astype(np.int64)
            more, _ = self._step(h, a, b, to_right)
            i[at], j[at] = a + sign * more, b + sign * more
        return sign * (i - first)


def _candidates(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group of neighbouring candidates of one period: period, first and last multiple of it (as factors)."""
    periods, firsts, lasts = [], [], []
    for q in range(1, longest // REPEATS + 1):
        grid = symbols[::q]
        same = grid[1:] == grid[:-1]
        four = same[: len(same) - REPEATS + 2].copy()
        for k in range(1, REPEATS - 1):
            four &= same[k : len(same) - REPEATS + 2 + k]
        if four.any():
            edge = np.diff(np.concatenate([[0], four.view(np.int8), [0]]))
            first = np.flatnonzero(edge == 1)
            periods.append(np.full(len(first), q))
            firsts.append(first)
            lasts.append(np.flatnonzero(edge == -1) - 1)
    if not periods:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(periods), np.concatenate(firsts), np.concatenate(lasts)


def find_runs(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence, by start, then period; texts in it are at most ``longest`` long.

    A run is a maximal stretch with smallest period q and max(6, 4q) words or more.
    """
    period, at, last = _candidates(symbols, longest)
    found = []
    if len(period):
        grammar = Grammar(symbols)
        width = np.ones(len(period), np.int64)
    while len(period):
        # a group looks at one candidate, then at twice as many each time, until one gives a stretch to pass over
        width = np.minimum(np.minimum(width, last - at + 1), QUERIES)
        total = np.cumsum(width)
        turn = np.maximum(1, np.searchsorted(total, QUERIES, side="right"))
        now, later = slice(0, turn), slice(turn, None)
        group = np.repeat(np.arange(turn), width[now])
        q = period[group]
        factor = at[group] + X.expand(width[now])
        i = factor * q
        ahead = grammar.extension(i, i + q, True)
        before = grammar.extension(i, i + q, False)
        length = q + ahead + before
        long = length >= np.maximum(SHORTEST, REPEATS * q)
        found.append(np.stack([(i - before)[long], length[long], q[long]], axis=1))
        # next factor with four multiples that are not all inside the stretch of the last candidate
        end = np.cumsum(width[now]) - 1
        after = -(-(i + q + ahead)[end] // period[now]) - REPEATS + 1
        at = np.concatenate([np.maximum(factor[end] + 1, after), at[later]])
        width = np.concatenate([2 * width[now], width[later]])
        keep = at <= last
        period, at, last, width = period[keep], at[keep], last[keep], width[keep]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period: the first of a stretch has its smallest period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _scan(batches):
    for batch in X.chunks(batches):
        data, offsets = X.text_buffer(batch.column("text"))
        starts, ends, first = X.find_words(data, offsets)
        count = np.diff(first)
        _, ids = np.unique(X.hash_spans(data, starts, ends), return_inverse=True)
        owner = np.repeat(np.arange(len(batch)), count)
        symbols = np.empty(len(ids) + len(batch), np.int64)
        place = np.arange(len(ids)) + owner  # a symbol of its own after each text
        symbols[place] = ids
        symbols[first[1:] + np.arange(len(batch))] = len(ids) + np.arange(len(batch))
        start, length, period = find_runs(symbols, int(count.max(initial=0)))
        of = np.searchsorted(first[1:] + np.arange(len(batch)), start, side="right")
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, start + period - of, 1)
        np.add.at(edge, start + length - of, -1)
        kept = np.cumsum(edge[:-1]) == 0
        bounds = np.searchsorted(of, np.arange(len(batch) + 1))
        struct = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[of] - of, length, period)], ["start", "length", "period"])
        raw, texts = data.tobytes(), []
        for k in range(len(batch)):
            own = raw[offsets[k] : offsets[k + 1]].split()
            if bounds[k] < bounds[k + 1]:
                own = [w for w, stays in zip(own, kept[first[k] : first[k + 1]].tolist(), strict=True) if stays]
            texts.append(b" ".join(own).decode())
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "n_words": count, "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct), "collapsed": pa.array(texts, pa.string())}
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text).

    Words are runs of anything but blanks and 0x09-0x0D, numbered from 0. A run is a stretch of words with smallest
    period q (words q apart are equal) and at least max(6, 4q) words which neither neighbour extends;
    ``runs`` has (start, length, period) of all of them by start, then period. ``collapsed`` are the words that no run
    holds after its first q words, joined by one blank. A null or empty text has no words and no runs. Every row is judged alone: rows that
    share a doc_id, or have none, are told apart. Other columns are ignored; an empty table gives no rows. A text is
    worked on whole in one task, in memory proportional to its length. Words are told apart by 64-bit hashes.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan, RESULT)
