"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled once per Python worker: the normaliser (white space to U+2581, dummy prefix), the
trie of its pieces as arcs weighted by their negative score, and byte fallback for characters without a
piece. A text composed with it is a lattice of positions and piece arcs, and its ids are the shortest path
in the tropical semiring. For a merge model (BPE) scores are merge priorities and not additive, so the
transducer also has a constraint on neighbours: the weight of an arc after another is infinite if merging
would have crossed their boundary. Exactly one arc into each position is then finite, so a position's
state keeps one last arc, as in the unconstrained case.

Batches run in lockstep: a text falls into units at places that no piece spans, each distinct unit of a
batch is composed once, and all units advance one position at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

BLANK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, MERGES = 1, 2
CHUNK = 1 << 20
PART = 1 << 16
_NEVER = 1 << 30


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(field, value) of a protocol-buffers message, without a schema."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = blob[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, blob[i : i + size]
            i += size


class IntMap:
    """Immutable map of non-negative integers to integers; looks up whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot, at = self._slot(keys), np.arange(len(keys))
        while len(at):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[at[won]], values[at[won]]
            stay = np.ones(len(at), bool)
            stay[won] = False
            slot, at = (slot[stay] + 1) & self.mask, at[stay]

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is absent."""
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], -1)
        at = np.flatnonzero((have != keys) & (have >= 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            have = self.keys[slot]
            hit = have == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            more = ~hit & (have >= 0)
            at, slot = at[more], slot[more]
        return out


class Transducer:
    """Compiled model. ``encode`` and ``decode`` work on Arrow string and id-list arrays."""

    def __init__(self, blob: bytes):
        self.pieces, scores, kinds = [], [], []
        self.model, prefix, trim, escape, charsmap, fallback = UNIGRAM, 1, 1, 1, b"", 0
        for field, value in _fields(blob):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                scores.append(float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]))
                kinds.append(own.get(3, NORMAL))
            elif field == 2:
                own = dict(_fields(value))
                self.model, fallback = own.get(3, UNIGRAM), own.get(35, 0)
            elif field == 3:
                own = dict(_fields(value))
                charsmap, prefix, trim, escape = own.get(2, b""), own.get(3, 1), own.get(4, 1), own.get(5, 1)
        if charsmap or trim or not escape or self.model not in (UNIGRAM, MERGES) or 4 in kinds:
            raise ValueError("only models with the identity normaliser, escaped blanks and without user-defined symbols")
        self.prefix = bool(prefix)
        self.seen = X.Units()
        self.kinds = np.array(kinds)
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = None
        if fallback:
            table = {self.pieces[k]: k for k, kind in enumerate(kinds) if kind == BYTE}
            self.byte_ids = np.array([table[f"<0x{b:02X}>"] for b in range(256)])
        self.other = len(self.pieces)  # a character without a piece
        self.weight = -np.array([*scores, -1e6])
        normal = [k for k, kind in enumerate(kinds) if kind == NORMAL]
        if self.model == MERGES:
            normal = self._compile_merges(normal, scores)
        self._compile_trie(normal)
        spell = [(bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(BLANK, " ").encode() if kind == NORMAL else b" \xe2\x81\x87 " if kind == UNKNOWN else b"") for p, kind in zip(self.pieces, kinds, strict=True)]
        self.spell_len = np.array([len(b) for b in spell], np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self.spell = np.frombuffer(b"".join(spell), np.uint8)

    def _compile_merges(self, normal: list[int], scores: list[float]) -> list[int]:
        """Turn of each piece's merge (0: a single character), its last parts, and which pairs merge to what."""
        ids = {self.pieces[k]: k for k in normal}
        turn = np.zeros(self.other + 1, np.int64)
        for n, k in enumerate(sorted((k for k in normal if len(self.pieces[k]) > 1), key=lambda k: -scores[k])):
            turn[k] = n + 1
        self.turn, self.left, self.right = turn, np.arange(self.other + 1), np.arange(self.other + 1)
        pairs, used = {}, []
        for k in normal:
            p = self.pieces[k]
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = k
            parts = [ids.get(c, -1) for c in p]
            last = (k, k)
            while len(parts) > 1 and -1 not in parts:
                step = min(((turn[ids[s]], n) for n in range(len(parts) - 1) if (s := self.pieces[parts[n]] + self.pieces[parts[n + 1]]) in ids), default=None)
                if step is None:
                    break
                n = step[1]
                last = parts[n], parts[n + 1]
                parts[n : n + 2] = [ids[self.pieces[last[0]] + self.pieces[last[1]]]]
            if parts == [k]:  # otherwise merging never yields this piece
                used.append(k)
                self.left[k], self.right[k] = last
        self.pairs = IntMap(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        return used

    def _compile_trie(self, normal: list[int]) -> None:
        alphabet = sorted({c for k in normal for c in self.pieces[k]})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        number = {c: n + 1 for n, c in enumerate(alphabet)}
        self.fan = len(alphabet) + 1
        arcs, piece_of = {}, [-1]
        for k in normal:
            node = 0
            for c in self.pieces[k]:
                key = node * self.fan + number[c]
                if key not in arcs:
                    arcs[key] = len(piece_of)
                    piece_of.append(-1)
                node = arcs[key]
            piece_of[node] = k
        self.arcs = IntMap(np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int64))
        self.piece_of = np.array(piece_of)
        #: Places that no piece spans: before a blank that follows another character, and around control characters.
        self.cut_blanks = not any(BLANK in self.pieces[k].lstrip(BLANK) for k in normal)
        self.cut_controls = not any(len(self.pieces[k]) > 1 and min(self.pieces[k]) < " " for k in normal)

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b beside each other: undo both, last merge first, and look for a merge across."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a < self.other) & (b < self.other))
        x, y = a[at], b[at]
        until_x, until_y = np.full(len(at), _NEVER), np.full(len(at), _NEVER)
        while len(at):
            across = self.pairs.get(x << 20 | y)
            turn = np.where(across >= 0, self.turn[across], _NEVER)
            bad = (turn < until_x) & (turn <= until_y)
            out[at[bad]] = False
            tx, ty = self.turn[x], self.turn[y]
            go = ~bad & ((tx > 0) | (ty > 0))
            at, x, y, tx, ty, until_x, until_y = (v[go] for v in (at, x, y, tx, ty, until_x, until_y))
            first = tx > ty
            until_x, until_y = np.where(first, tx, until_x), np.where(first, until_y, ty)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def _lattice(self, letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every arc."""
        start = np.arange(len(letters))
        node, pos, stop = np.zeros(len(letters), np.int64), start, ends
        found = [(start[letters == 0], start[letters == 0] + 1, np.full((letters == 0).sum(), self.other))]
        while len(start):
            node = self.arcs.get(node * self.fan + letters[pos])
            ok = node >= 0
            start, node, pos, stop = start[ok], node[ok], pos[ok] + 1, stop[ok]
            piece = self.piece_of[node]
            has = piece >= 0
            found.append((start[has], pos[has], piece[has]))
            ok = pos < stop
            start, node, pos, stop = start[ok], node[ok], pos[ok], stop[ok]
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def units(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest path of every unit (code points, n + 1 offsets): ids one after the other, and their n + 1 offsets."""
        size = np.diff(offsets)
        letters = self.letter[codes].astype(np.int64)
        unit = np.repeat(np.arange(len(size)), size)
        start, end, piece = self._lattice(letters, offsets[1:][unit])
        # State of position p of unit u at p + u; longer arcs first within an end.
        own = unit[start]
        local = end - offsets[:-1][own]
        order = np.argsort(local * len(codes) + start)
        start, end, piece, own, local = (v[order] for v in (start, end, piece, own, local))
        source, target = start + own, end + own
        n = len(codes) + len(size)
        dist, back, last = np.full(n, np.inf), np.full(n, -1), np.full(n, self.other)
        dist[offsets[:-1] + np.arange(len(size))] = 0.0
        bounds = np.searchsorted(local, np.arange(1, (size.max() if len(size) else 0) + 2))
        for p in range(len(bounds) - 1):
            lo, hi = bounds[p], bounds[p + 1]
            s, t, c = source[lo:hi], target[lo:hi], piece[lo:hi]
            while len(s):
                _, first = np.unique(t, return_index=True)  # one arc into each position at a time
                fs, ft, fc = s[first], t[first], c[first]
                cost = dist[fs] + self.weight[fc]
                if self.model == MERGES:
                    cost[~self._may_follow(last[fs], fc)] = np.inf
                better = cost < dist[ft]
                ft = ft[better]
                dist[ft], back[ft], last[ft] = cost[better], fs[better], fc[better]
                rest = np.ones(len(s), bool)
                rest[first] = False
                if self.model == MERGES:  # the only finite arc is found
                    rest &= dist[t] == np.inf
                s, t, c = s[rest], t[rest], c[rest]
        begin, at = offsets[:-1] + np.arange(len(size)), offsets[1:] + np.arange(len(size))
        ids, owner, step = [], [], []
        live, k = np.flatnonzero(size > 0), 0
        at = at[live]
        while len(live):
            ids.append(np.where(last[at] == self.other, -1 - codes[np.minimum(back[at] - live, len(codes) - 1)], last[at]))
            owner.append(live)
            step.append(np.full(len(live), k))
            at, k = back[at], k + 1
            more = at > begin[live]
            at, live = at[more], live[more]
        if not ids:
            return np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
        ids, owner, step = np.concatenate(ids), np.concatenate(owner), np.concatenate(step)
        order = np.lexsort((-step, owner))
        ids, owner = ids[order], owner[order]
        if (lost := ids < 0).any():
            if self.byte_ids is None:
                ids[lost] = self.unknown
            else:
                raw = [chr(-1 - c).encode() for c in ids[lost]]
                count = np.ones(len(ids), np.int64)
                count[lost] = [len(b) for b in raw]
                owner, where = np.repeat(owner, count), np.repeat(lost, count)
                ids = np.repeat(ids, count)
                ids[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.searchsorted(owner, np.arange(len(size) + 1))

    def _work_out(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        raw = data[np.repeat(starts, size) + X.expand(size)]
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ids, at = self.units(np.where(codes == 32, ord(BLANK), codes), seen[np.concatenate([[0], np.cumsum(size)])])
        return ids, at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and the n + 1 offsets; null and empty texts have none."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        if self.prefix:
            column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        data, offsets = X.text_buffer(column)
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        begin = begin[:-1]
        if self.cut_blanks:
            begin[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        if self.cut_controls:
            control = data < 32
            begin |= control
            begin[1:] |= control[:-1]
        starts = np.flatnonzero(begin)
        ids, count = self.seen.spans(data, starts, np.append(starts[1:], len(data))[: len(starts)], self._work_out)
        return ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists; bytes that are not UTF-8 become U+FFFD."""
        size = self.spell_len[ids]
        parts = []
        for lo in range(0, len(ids), PART):  # an index for every byte is eight times the text
            own = size[lo : lo + PART]
            parts.append(self.spell[np.repeat(self.spell_at[ids[lo : lo + PART]], own) + X.expand(own)].tobytes())
        data = b"".join(parts)
        total = np.concatenate([[0], np.cumsum(size)])[offsets]
        skip = 1 if self.prefix else 0
        return [data[a + (skip and data[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def _compiled(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def load(path: str | None = None) -> Transducer:
    return _compiled(path or default_model())


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) of every row of ``docs`` (doc_id, text), one row for each.

    ``decoded`` is the text rebuilt from the ids; with a lossless model it equals ``text``. A null or empty
    text has no ids and decodes to the empty text; a null doc_id stays null. Other columns are ignored.
    ``model`` is the path of a model file that every executor has.
    """

    def run(batches):
        fst = load(model)
        for batch in X.chunks(batches, limit=CHUNK):
            ids, offsets = fst.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            out = {"doc_id": batch.column("doc_id"), "ids": lists, "n_tokens": np.diff(offsets), "decoded": pa.array(fst.decode(ids, offsets), pa.string())}
            del batch
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null or empty id lists give the empty text."""

    def run(batches):
        fst = load(model)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            flat = np.array([x for ids in lists for x in ids or ()], np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(ids or ()) for ids in lists])]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(fst.decode(flat, offsets), pa.string())})

    return rows.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
