"""Removal of passages that repeat across documents, by level-wise doubling.

A window of ``size`` words can repeat only if its halves do. So windows of half the size (quarter, ... for
larger sizes, down to ``SHORTEST``) are looked at first, and only where they repeat are windows of twice the
length formed and looked at in turn. Equal windows hold equal shorter windows at equal places, so of all the
shorter windows inside one it is enough to look at a chosen one: that of the least hash. That makes a level's
table a fraction of the words, and no repeated window is lost.

A level's table holds (hash, doc_id) once for each document, and is aggregated before its shuffle; per
document, the hashes that survive come back as one array. Documents whose whole word sequence is that of a
smaller doc_id lose all their words and are left out of the levels: the smaller one stands for them.

Windows are told apart by 64-bit hashes, whole sequences by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import text as X

WINDOW = 50
SHORTEST = 24


def levels(size: int) -> list[int]:
    """Window lengths from short to ``size``, each at most twice the one before."""
    out = [size]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[: len(values) - span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    n = len(values) - (width - span)
    return np.minimum(values[:n], values[width - span :]) if n > 0 else values[:0]


def _anchors(words: np.ndarray, length: int, size: int) -> np.ndarray:
    """For every window of ``size`` words, the least hash of the windows of ``length`` words in it."""
    grams = X.gram_hashes(words, length)
    return grams if length == size else _least(grams, size - length + 1)


def _windows(count: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    full = np.maximum(count - size + 1, 0)
    return np.repeat(first[:-1], full) + X.expand(full), np.repeat(np.arange(len(count)), full)


def _in_lists(values: np.ndarray, owner: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its owner."""
    out = np.zeros(len(values), bool)
    bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(np.nan_to_num(sizes.astype(float)) > 0):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            own = np.sort(lists[k].values.to_numpy().view(np.uint64))
            at = np.minimum(np.searchsorted(own, values[a:b]), len(own) - 1)
            out[a:b] = own[at] == values[a:b]
    return out


def _table(length: int, size: int, after: int | None):
    """(hash, doc_id): once per document, the anchors of this length of its windows that survive the level before.

    The first level adds a row for the whole sequence of each document that has a window, with a second hash in ``whole``.
    """

    def run(batches):
        for batch in X.chunks(batches):
            data, offsets = X.text_buffer(batch.column("text"))
            starts, ends, first = X.find_words(data, offsets)
            words = X.hash_spans(data, starts, ends)
            at, owner = _windows(np.diff(first), first, size)
            if after is not None and len(at):
                alive = _in_lists(_anchors(words, after, size)[at], owner, batch.column("alive"))
                at, owner = at[alive], owner[alive]
            values = _anchors(words, length, size)[at] if len(at) else np.zeros(0, np.uint64)
            keep = np.ones(len(values), bool)
            keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])  # runs; the rest goes in the aggregate
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"hash": X.signed(values[keep]), "doc_id": ids[owner[keep]].astype(np.int64), "whole": pa.nulls(int(keep.sum()), pa.int64())})
            if after is None:
                long = np.flatnonzero(np.diff(first) >= size)
                place = X.mix(X.expand(np.diff(first)).astype(np.uint64))
                one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(words ^ X.mix(place + np.uint64(k))))]) for k in (1, 2))
                of = lambda total: X.signed((total[first[1:]] - total[first[:-1]])[long])
                yield pa.RecordBatch.from_pydict({"hash": of(one), "doc_id": ids[long].astype(np.int64), "whole": of(two)})

    return run


def _cover(size: int):
    def run(batches):
        for batch in X.chunks(batches):
            data, offsets = X.text_buffer(batch.column("text"))
            starts, ends, first = X.find_words(data, offsets)
            words = X.hash_spans(data, starts, ends)
            at, owner = _windows(np.diff(first), first, size)
            hit = _in_lists(X.gram_hashes(words, size)[at], owner, batch.column("gone")) if len(at) else np.zeros(0, bool)
            hit |= pc.fill_null(batch.column("copy"), False).to_numpy(zero_copy_only=False)[owner]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + size, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            n_removed = removed[first[1:]] - removed[first[:-1]]
            raw, texts, digests = data.tobytes(), [], []
            for k in range(len(batch)):
                own = raw[offsets[k] : offsets[k + 1]].split()
                if n_removed[k]:
                    own = [w for w, lost in zip(own, gone[first[k] : first[k + 1]], strict=True) if not lost]
                joined = b" ".join(own)
                texts.append(joined.decode())
                digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": np.diff(first), "n_removed": n_removed, "kept_sha256": digests, "kept_text": pa.array(texts, pa.string())})

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of ``docs`` (doc_id, text).

    Removes each word covered by a window of ``size`` consecutive words whose sequence also starts in a
    document of a smaller doc_id; all windows are judged on the input. Kept words are joined by one space.
    A null text has no words. Rows of a null doc_id lose nothing and take nothing from others; rows that share
    a doc_id do not take from each other. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = own.where("doc_id IS NOT NULL AND text IS NOT NULL")
    source, before, gone, copies = known, None, None, None
    for length in levels(size):
        table = cut_lineage(source.mapInArrow(_table(length, size, before), "hash long, doc_id long, whole long"))
        if copies is None:
            copies = cut_lineage(_copies(table.where("whole IS NOT NULL")))
            table = table.where("whole IS NULL").join(copies, "doc_id", "leftanti")
        table = table.select("hash", "doc_id")
        seen = table.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        if length == size:
            gone = table.join(seen, "hash").where("doc_id > least").groupBy("doc_id").agg(F.collect_set("hash").alias("gone"))
        else:
            alive = table.join(seen.select("hash"), "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("alive"))
            source, before = known.join(alive, "doc_id"), length
    gone = gone.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", F.array().cast("array<long>").alias("gone"), F.lit(True).alias("copy")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return own.join(gone, "doc_id", "left").mapInArrow(_cover(size), schema)


def _copies(sequences: DataFrame) -> DataFrame:
    """(doc_id): documents that have one sequence, which a smaller doc_id has too."""
    least = sequences.groupBy("hash", "whole").agg(F.min("doc_id").alias("least"))
    per = sequences.join(least, ["hash", "whole"]).groupBy("doc_id")
    per = per.agg(F.min(F.struct("hash", "whole")).alias("a"), F.max(F.struct("hash", "whole")).alias("b"), F.min("least").alias("least"))
    return per.where("a = b AND least < doc_id").select("doc_id")
