"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Items and documents are brought to one form: words are runs of letters, digits and everything beyond ASCII,
A-Z in small letters, with one blank before, between and after them. The patterns of an item are its windows of
``window`` consecutive words (the whole item if it has fewer), blanks at both ends included, so that a pattern
meets whole words only. The automaton passes over the form of each document once; its output links report
all windows that end at a place, short items inside others among them. Word numbers lead back from the form to
the original text.

An automaton is built in each Python worker from the item texts, which travel with the task. Their size is
added up first: beyond ``AUTOMATON_CHARS`` the windows are dealt by hash to as many automata as it takes, and the
documents pass them one after the other, each pass a written table, so that no worker holds two of them.
"""

from __future__ import annotations

import hashlib
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import text as X

WINDOW = 10
#: Item text of one automaton, in code points; it has at most ``window`` times as many nodes.
AUTOMATON_CHARS = 400_000
PIECE_WORDS = 2000

INK = np.zeros(256, bool)
INK[48:58] = INK[65:91] = INK[97:123] = INK[128:] = True
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if INK[b] else 32 for b in range(256))
STATE = "doc_id long, text string, ranges array<long>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_READY: dict[str, tuple] = {}


def normal_form(text: str | None) -> bytes:
    """The words of a text in small letters with one blank before, between and after them; one blank if there are none."""
    return b" ".join((b"", *(text or "").encode().translate(FOLD).split(), b""))


def _pieces(window: int):
    """(item_id, piece): the form of an item in overlapping pieces, so that every window is whole in one of them."""

    def run(batches):
        for batch in batches:
            ids, pieces = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = normal_form(text).decode().split()
                for at in range(0, max(len(own) - window + 1, min(len(own), 1)), PIECE_WORDS):
                    ids.append(item)
                    pieces.append(" ".join(own[at : at + PIECE_WORDS + window - 1]))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.string()), "piece": pa.array(pieces, pa.string())})

    return run


def _automaton(items: list[tuple[str, str]], window: int) -> tuple:
    """(automaton, words of each pattern, items of each pattern); the automaton is None without patterns.

    The last one built stays for the next tasks of this worker.
    """
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        owners: dict[str, set] = {}
        for item, piece in items:
            own = piece.split(" ")
            for at in range(max(1, len(own) - window + 1)):
                owners.setdefault(f" {' '.join(own[at : at + window])} ", set()).add(item)
        automaton = ahocorasick.Automaton()
        for k, pattern in enumerate(owners):
            automaton.add_word(pattern, k)
        if owners:
            automaton.make_automaton()
        sizes = np.fromiter((p.count(" ") - 1 for p in owners), np.int64, len(owners))
        _READY[key] = (automaton if owners else None, sizes, list(owners.values()))
    return _READY[key]


def _merged(ranges: np.ndarray, n_words: int) -> np.ndarray:
    """First and end of every maximal run of words that some (first, end) covers."""
    depth = np.zeros(n_words + 2, np.int64)
    np.add.at(depth, ranges[:, 0] + 1, 1)
    np.add.at(depth, ranges[:, 1] + 1, -1)
    inside = np.cumsum(depth) > 0
    return np.stack([np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])], axis=1)


def _original(text: str, ranges: np.ndarray) -> np.ndarray:
    """Ranges of words as ranges of code points of the original text."""
    data = np.frombuffer(text.encode(), np.uint8)
    ink = np.concatenate([[False], INK[data], [False]])
    starts, ends = np.flatnonzero(~ink[:-1] & ink[1:]), np.flatnonzero(ink[:-1] & ~ink[1:])
    points = np.cumsum((data & 0xC0) != 0x80)
    return np.stack([points[starts[ranges[:, 0]]] - 1, points[ends[ranges[:, 1] - 1] - 1]], axis=1)


def _scan(items: list[tuple[str, str]], window: int, last: bool):
    """One automaton over all documents; hits are added to those of the passes before."""

    def run(batches):
        automaton, sizes, owners = _automaton(items, window)
        for batch in X.chunks(batches):
            rows = []
            for text, ranges, names in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "items")), strict=True):
                form = normal_form(text).decode()
                n_words = form.count(" ") - 1
                ranges, names = np.array(ranges, np.int64).reshape(-1, 2), set(names)
                found = list(automaton.iter(form)) if automaton is not None and n_words else []
                if found:
                    ends, which = np.array(found, np.int64).T
                    blanks = np.flatnonzero(np.frombuffer(form.encode("utf-32-le"), np.uint32) == 32)
                    end = np.searchsorted(blanks, ends)
                    ranges = _merged(np.concatenate([ranges, np.stack([end - sizes[which], end], axis=1)]), n_words)
                    names.update(itertools.chain.from_iterable(owners[k] for k in np.unique(which)))
                rows.append((n_words, ranges, sorted(names)))
            out = {"doc_id": batch.column("doc_id"), "items": pa.array([r[2] for r in rows], pa.list_(pa.string()))}
            if last:
                texts = batch.column("text").to_pylist()
                spans = [[{"start": a, "end": b} for a, b in _original(t, r[1]).tolist()] if len(r[1]) else [] for t, r in zip(texts, rows, strict=True)]
                out["n_words"] = pa.array([r[0] for r in rows], pa.int64())
                out["n_hit"] = pa.array([int((r[1][:, 1] - r[1][:, 0]).sum()) for r in rows], pa.int64())
                out["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                names = ["doc_id", "n_words", "n_hit", "items", "spans"]
            else:
                out["text"] = batch.column("text")
                out["ranges"] = pa.array([r[1].ravel().tolist() for r in rows], pa.list_(pa.int64()))
                names = ["doc_id", "text", "ranges", "items"]
            yield pa.RecordBatch.from_pydict({name: out[name] for name in names})

    return run


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of ``docs`` (doc_id, text), given ``items`` (item_id, text).

    ``n_hit`` counts the words inside any occurrence of a window of any item, ``items`` has the ids, as strings in
    order, of the items with an occurring window, ``spans`` the runs of hit words as (start, end) in code points of
    the original text, end exclusive, in order. A null or empty text has no words: such a document has no hits,
    such an item no window. Rows of a null item_id take no part; rows of one item_id are one item; rows of
    ``docs`` that share a doc_id, or have none, each get their own row. Other columns are ignored; empty tables give no rows
    or no hits. A text of any length is scanned whole in one task. ``limit`` bounds the item text of one automaton.
    """
    own = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = cut_lineage(own.mapInArrow(_pieces(window), "item_id string, piece string").distinct())
    passes = (pieces.agg(F.sum(F.char_length("piece"))).first()[0] or 0) // limit + 1
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.array().cast("array<long>").alias("ranges"), F.array().cast("array<string>").alias("items"),
    )
    for k in range(passes):
        share = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(passes)) == k)
        listed = sorted((r["item_id"], r["piece"]) for r in share.collect())  # about ``limit`` code points, as dealt above
        if k < passes - 1:
            state = cut_lineage(state.mapInArrow(_scan(listed, window, False), STATE))
        else:
            state = state.mapInArrow(_scan(listed, window, True), RESULT)
    return state
