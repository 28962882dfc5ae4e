"""Token ids in binary files, coded by an adaptive context-mixing range coder.

A file is a row of segments; a segment lists its documents (id, number of tokens) and codes their tokens in
blocks of ``BLOCK``. Every block starts from empty models and has a checksum, so it is read on its own and a
damaged one is found. In a block, three orders predict the next id: order 2 the id that followed the last two
before, order 1 the one that followed the last before, order 0 every id by its frequency in the block. The
shares of the orders come from a mixer (``_Mixer``): three sets of adaptive frequencies of which order was
right, weighted by how well each set did so far. With shares w2, w1 and w0 an id x has the probability of the
highest order that foretells it, w2, w1 or w0 * frequency(x), and is range coded by it; an id that the block has
not had takes what is left, its bit-length class by adaptive frequencies and its place in the class evenly.
Contexts are hashed to ``SLOT_BITS`` bits. Frequencies and weights are renewed at fixed steps and
learn then from all ids since.

The blocks of a segment are decoded in lockstep, one id of every block at a time. For encoding, all predictions
follow from sorting the block by context, so only the coder itself goes in lockstep.
"""

from __future__ import annotations

import math
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from . import text as X
from .warc import _place

MAGIC = b"BDT2"
BLOCK_BITS, LANES, SEGMENT_BLOCKS = 12, 2048, 2048
BLOCK = 1 << BLOCK_BITS
ROWS_PER_FILE = 8192
END_ID = 1
CHUNK = 4 << 20
SLOT_BITS, CLASSES = 12, 64  # of the classes, 36 are in use
STEP, LIMIT, TOTAL = 24, 1 << 12, 1 << 12
#: Steps at which the order-0 frequencies take in the ids so far, and the distance of renewals of the mixer.
ORDER_0, WEIGHTS_EVERY = (0, 32, 64, 128, 256, 512, 1024, 1536, 2048, 3072), 128
_U32, _U64 = np.uint32, np.uint64
_TOP, _BOTTOM, _SHARE = _U64(1 << 48), _U64(1 << 32), _U64(12)
#: Bits that a share of TOTAL costs, in 1/16 bits, and 2 ** -(bits) of cost, in 16 bits.
_COSTS = np.array([192] + [round(16 * (12 - math.log2(n))) for n in range(1, TOTAL + 1)])
_POWERS = np.array([1 << max(0, 16 - n) for n in range(17)])


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


# ---- range coder, one state per lane: 64-bit low and range, 16 bits moved at a time


class _Encoder:
    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, _U64), np.full(lanes, (1 << 64) - 1, _U64)
        self.room, self.out = room, np.zeros(lanes * room, ">u2")
        self.at = np.arange(lanes) * room

    def move(self, lanes: np.ndarray) -> None:
        self.out[self.at[lanes]] = self.low[lanes] >> _U64(48)
        self.at[lanes] += 1

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(4):
            self.move(every)
            self.low <<= _U64(16)
        return [self.out[k * self.room : end].tobytes() for k, end in enumerate(self.at.tolist())]


class _Decoder:
    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.low, self.range = np.zeros(len(starts), _U64), np.full(len(starts), (1 << 64) - 1, _U64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.pairs = np.ndarray((len(padded) - 1,), ">u2", buffer=padded, strides=(1,))
        self.at, self.code = starts.astype(np.int64), np.zeros(len(starts), _U64)
        for _ in range(4):
            self.move(np.arange(len(starts)))

    def move(self, lanes: np.ndarray) -> None:
        self.code[lanes] = (self.code[lanes] << _U64(16)) | self.pairs[np.minimum(self.at[lanes], len(self.pairs) - 1)]
        self.at[lanes] += 2


def _settle(coder, lanes: np.ndarray | None = None) -> None:
    """Moves 16 bits in or out while the top 16 are fixed or the range has become small, of all lanes or of these."""
    low, wide = (coder.low, coder.range) if lanes is None else (coder.low[lanes], coder.range[lanes])
    go = np.flatnonzero(((low ^ (low + wide)) < _TOP) | (wide < _BOTTOM))
    go = go if lanes is None else lanes[go]
    while len(go):
        low, wide = coder.low[go], coder.range[go]
        tight = (low ^ (low + wide)) >= _TOP
        if tight.any():
            wide[tight] = (~low[tight] + _U64(1)) & (_BOTTOM - _U64(1))
        coder.move(go)
        low <<= _U64(16)
        wide <<= _U64(16)
        coder.low[go], coder.range[go] = low, wide
        go = go[((low ^ (low + wide)) < _TOP) | (wide < _BOTTOM)]


# ---- models, one set per lane


def _renewals(steps: int) -> list[int]:
    """The steps at which frequencies and weights are renewed; those in ``ORDER_0`` renew the order-0 frequencies too."""
    return sorted({t for t in ORDER_0 if t < steps} | {0, *range(WEIGHTS_EVERY, steps, WEIGHTS_EVERY)})


class _Mixer:
    """The share of each order, mixed from three sets of adaptive frequencies.

    Of an id it is counted who foretold it: order 2, order 1, order 0, or none (new). Every set counts that under
    a context of its own: nothing, the record of order 1, the records of both. The shares under which an id is
    coded are the three sets' frequencies, weighted by 2 ** -cost, cost being the bits that the set would have
    spent on who foretold the ids so far, the older ones at half. All of it is in integers, so coder and decoder agree.
    """

    ROWS = 32

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.base = np.arange(lanes) * self.ROWS
        self.sets = [np.tile(np.array([1, 1, 2, 4], np.int64), (lanes, n, 1)) for n in (1, 8, self.ROWS)]
        self.cost = [np.zeros(lanes, np.int64) for _ in self.sets]
        self.classes = np.zeros((lanes, CLASSES), np.int64)
        self.classes[:, :36] = 1
        self._mix()

    def _mix(self) -> None:
        self.shares = [np.maximum(1, (s << 12) // s.sum(2, keepdims=True)) for s in self.sets]
        least = np.minimum.reduce(self.cost)
        mixed = 0
        for share, cost in zip(self.shares, self.cost, strict=True):
            weight = _POWERS[np.minimum((cost - least) >> 4, len(_POWERS) - 1)]
            mixed = mixed + np.tile(share * weight[:, None, None], (1, self.ROWS // share.shape[1], 1))
        part = 1 + mixed * (TOTAL - 4) // mixed.sum(2, keepdims=True)
        upto = np.zeros((self.lanes, self.ROWS, 5), _U64)
        np.cumsum(part[:, :, :3], 2, out=upto[:, :, 1:4])
        upto[:, :, 4] = TOTAL
        self.upto = upto.reshape(-1)
        upto = np.zeros((self.lanes, CLASSES), _U64)
        np.cumsum(self.classes[:, :-1], 1, out=upto[:, 1:])
        self.class_upto, self.class_total = upto.reshape(-1), np.ascontiguousarray(upto[:, -1])

    def learn(self, rows: np.ndarray, who: np.ndarray, class_at: np.ndarray) -> None:
        """Takes in what was seen since: the row of every id and who foretold it; (lane, class) of the new ones."""
        seen = np.bincount(rows.reshape(-1) * 4 + who.reshape(-1), minlength=self.lanes * self.ROWS * 4).reshape(self.lanes, self.ROWS, 4)
        for k, own in enumerate(self.sets):
            n = seen.reshape(self.lanes, -1, own.shape[1], 4).sum(1)
            self.cost[k] = (self.cost[k] >> 1) + (n * _COSTS[self.shares[k]]).sum((1, 2))
            own += STEP * n
            full = own.sum(2) > LIMIT
            own[full] = (own[full] + 1) >> 1
        self.classes += STEP * np.bincount(class_at, minlength=self.lanes * CLASSES).reshape(self.lanes, CLASSES)
        while (full := self.classes.sum(1) > LIMIT).any():
            self.classes[full] = (self.classes[full] + 1) >> 1
        self._mix()


def _slots(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the order-1 and order-2 contexts in a lane's tables."""
    h1 = last * _U32(2654435769)
    h2 = (h1 ^ (before * _U32(2246822519))) * _U32(3266489917)
    return h1 >> _U32(32 - SLOT_BITS), h2 >> _U32(32 - SLOT_BITS)


def _class_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id (bit length of id + 1, and the bit after the first) and number of bits that are left."""
    bits = np.frexp((ids + 1).astype(np.float64))[1]
    free = np.maximum(bits - 2, 0)
    return np.where(bits == 1, 0, 2 * bits - 3 + ((ids + 1) >> free & 1)).astype(np.int64), free.astype(np.int64)


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row: steps in the order of (key, step), and whether a step has the key of the one before it there."""
    packed = (keys.astype(np.uint64) << _U64(BLOCK_BITS)) | np.arange(keys.shape[1], dtype=np.uint64)
    if not keys.size or int(keys.max()) < 1 << (32 - BLOCK_BITS):
        packed = packed.astype(np.uint32)
    packed.sort(axis=1)
    key = packed >> packed.dtype.type(BLOCK_BITS)
    same = np.zeros(keys.shape, bool)
    same[:, 1:] = key[:, 1:] == key[:, :-1]
    return (packed & packed.dtype.type(BLOCK - 1)).astype(np.int64), same


def _record(ids: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What followed each step's context before (-1: it is new), how sure that is (0..3), and whether it is right."""
    order, same = _by_key(slots)
    prior = np.zeros_like(order)
    prior[:, 1:] = order[:, :-1]
    before, known = np.zeros_like(order), np.zeros(ids.shape, bool)
    np.put_along_axis(before, order, prior, 1)
    np.put_along_axis(known, order, same, 1)
    guess = np.where(known, np.take_along_axis(ids, before, 1), -1)
    right = guess == ids
    once = known & np.take_along_axis(right, before, 1)
    twice = once & np.take_along_axis(once, before, 1)
    return guess, known.astype(np.uint8) + once + twice, right


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every id: how many of the ids that the order-0 frequencies hold at its step are smaller, and how many are equal."""
    lanes, steps = ids.shape
    order, same = _by_key(ids)
    step = np.arange(steps)
    first = np.maximum.accumulate(np.where(same, 0, step), axis=1)
    last = np.ones(ids.shape, bool)
    last[:, :-1] = ~same[:, 1:]
    end = np.minimum.accumulate(np.where(last, step + 1, steps)[:, ::-1], axis=1)[:, ::-1]
    below, equal = np.zeros(ids.shape, np.uint16), np.zeros(ids.shape, np.uint16)
    bounds = [t for t in ORDER_0 if t < steps] + [steps]
    place = np.zeros_like(order)
    np.put_along_axis(place, order, np.broadcast_to(step, ids.shape), 1)
    held = np.zeros((lanes, steps + 1), np.uint16)
    for a, b in zip(bounds, bounds[1:], strict=False):
        np.cumsum(order < a, axis=1, dtype=np.uint16, out=held[:, 1:])
        at = place[:, a:b]
        below[:, a:b] = np.take_along_axis(held, np.take_along_axis(first, at, 1), 1)
        equal[:, a:b] = np.take_along_axis(held, np.take_along_axis(end, at, 1), 1) - below[:, a:b]
    return below, equal


def _foresee(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row of the mixer, who foretells the id (0: order 2, 1: order 1, 2: order 0, 3: none), and its place in the order-0 frequencies."""
    last = np.zeros(ids.shape, _U32)
    last[:, 1:] = ids[:, :-1]
    before = np.zeros(ids.shape, _U32)
    before[:, 1:] = last[:, :-1]
    slot1, slot2 = _slots(last, before)
    guess1, sure1, right1 = _record(ids, slot1)
    guess2, sure2, right2 = _record(ids, slot2)
    below, equal = _frequencies(ids)
    row = sure2 << 3 | sure1 << 1 | (guess1 == guess2)
    return row, np.where(right2, 0, np.where(right1, 1, np.where(equal > 0, 2, 3))).astype(np.uint8), below, equal


def _encode_lanes(ids: np.ndarray) -> list[bytes]:
    """The coded blocks in the rows of ``ids`` (lane, step)."""
    lanes, steps = ids.shape
    parts = [[np.ascontiguousarray(x.T) for x in _foresee(ids[lo : lo + 128])] for lo in range(0, lanes, 128)]
    rows, whos, below, equal = (np.concatenate(x, axis=1) for x in zip(*parts, strict=True))
    coder, mixer = _Encoder(lanes, 4 * steps + 16), _Mixer(lanes)
    ids, lane = np.ascontiguousarray(ids.T), np.arange(lanes)
    bounds, held = _renewals(steps), 0
    for a, b in zip(bounds, bounds[1:] + [steps], strict=True):
        if a in ORDER_0:
            held = a
        who, row = whos[a:b], mixer.base + rows[a:b]
        at = row * 5 + who
        low1 = mixer.upto[at]
        size1 = mixer.upto[at + 1] - low1
        old, new = who == 2, who == 3
        kind, free = _class_of(ids[a:b])
        place = ((ids[a:b] + 1) & ((1 << free) - 1)).astype(_U64)
        at = lane * CLASSES + kind
        low2 = np.where(new, mixer.class_upto[at], np.where(old, below[a:b], 0).astype(_U64))
        size2 = np.where(new, mixer.class_upto[at + 1] - mixer.class_upto[at], np.where(old, equal[a:b], 1).astype(_U64))
        total = np.where(new, mixer.class_total, np.where(old, held, 1).astype(_U64))
        free = free.astype(_U64)
        for k in range(b - a):
            part = coder.range >> _SHARE
            coder.low += low1[k] * part
            part = (part * size1[k]) // total[k]
            coder.low += low2[k] * part
            coder.range = part * size2[k]
            _settle(coder)
            on = np.flatnonzero(new[k])
            if len(on):
                part = coder.range[on] >> free[k, on]
                coder.low[on] += place[k, on] * part
                coder.range[on] = part
                _settle(coder, on)
        mixer.learn(row, who, at[new])
    return coder.finish()


class _Guesses:
    """Of one order: the id that followed each context last, and how sure that is (id * 4 + 1..3; 0: nothing yet)."""

    def __init__(self, lanes: int):
        self.base, self.table = np.arange(lanes) << SLOT_BITS, np.zeros(lanes << SLOT_BITS, np.int32)

    def look(self, slot: np.ndarray) -> None:
        self.at = self.base + slot
        self.entry = self.table[self.at]
        self.sure = self.entry & 3
        self.id = (self.entry >> 2) - (self.entry == 0)

    def learn(self, ids: np.ndarray) -> None:
        self.table[self.at] = np.where(self.id == ids, self.entry + (self.sure < 3), ids << 2 | 1)


def _decode_lanes(data: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """The ids (lane, step) of the blocks that start there."""
    lanes = len(starts)
    coder, mixer, one, two = _Decoder(data, starts), _Mixer(lanes), _Guesses(lanes), _Guesses(lanes)
    lane, out = np.arange(lanes), np.zeros((steps, lanes), np.int32)
    last = before = np.zeros(lanes, _U32)
    totals, known = np.ones((lanes, 4), _U64), None
    bounds = _renewals(steps)
    for a, b in zip(bounds, bounds[1:] + [steps], strict=True):
        if a and a in ORDER_0:
            held = a
            known = np.sort(out[:a].T, axis=1)
            step, differs = np.arange(a, dtype=np.int32), np.ones(known.shape, bool)
            differs[:, 1:] = known[:, 1:] != known[:, :-1]
            first = np.maximum.accumulate(np.where(differs, step, 0), axis=1)
            ends = np.ones(known.shape, bool)
            ends[:, :-1] = differs[:, 1:]
            size = np.minimum.accumulate(np.where(ends, step + 1, a)[:, ::-1], axis=1)[:, ::-1] - first
            known, first, size = known.reshape(-1), first.reshape(-1), np.ascontiguousarray(size).reshape(-1)
            totals[:, 2] = a
        totals[:, 3] = mixer.class_total
        flat = totals.reshape(-1)
        rows, whos, fresh = np.zeros((b - a, lanes), np.int64), np.zeros((b - a, lanes), np.int64), []
        for k in range(b - a):
            slot1, slot2 = _slots(last, before)
            one.look(slot1)
            two.look(slot2)
            row = mixer.base + (two.sure << 3 | one.sure << 1 | (one.id == two.id))
            part = coder.range >> _SHARE
            goal = (coder.code - coder.low) // part
            at = row * 5
            who = (goal >= mixer.upto[at + 1]).astype(np.int64) + (goal >= mixer.upto[at + 2]) + (goal >= mixer.upto[at + 3])
            at += who
            low = mixer.upto[at]
            coder.low += low * part
            total = flat[lane * 4 + who]
            part = (part * (mixer.upto[at + 1] - low)) // total
            x = np.where(who == 0, two.id, one.id)
            goal = np.minimum((coder.code - coder.low) // part, total - _U64(1))
            low2, size2 = np.zeros(lanes, _U64), np.ones(lanes, _U64)
            on = np.flatnonzero(who == 2)
            if len(on) and known is not None:
                at = on * held + goal[on].astype(np.int64)
                x[on], low2[on], size2[on] = known[at], first[at], size[at]
            on = np.flatnonzero(who == 3)
            if len(on):
                base = at = on * CLASSES
                for half in (5, 4, 3, 2, 1, 0):  # on to the last class that begins at or below the goal, by halving
                    at = at + ((mixer.class_upto[at + (1 << half)] <= goal[on]).astype(np.int64) << half)
                low2[on] = mixer.class_upto[at]
                size2[on] = mixer.class_upto[at + 1] - mixer.class_upto[at]
                fresh.append(at)
            coder.low += low2 * part
            coder.range = part * size2
            _settle(coder)
            if len(on):
                kind = at - base
                free = np.maximum(kind - 1, 0) >> 1
                part = coder.range[on] >> free.astype(_U64)
                place = np.minimum((coder.code[on] - coder.low[on]) // part, ((1 << free) - 1).astype(_U64))
                coder.low[on] += place * part
                coder.range[on] = part
                _settle(coder, on)
                x[on] = (np.where(kind == 0, 1, 2 + (kind - 1 & 1)) << free | place.astype(np.int64)) - 1
            out[a + k], rows[k], whos[k] = x, row, who
            one.learn(x)
            two.learn(x)
            before, last = last, x.astype(_U32)
        mixer.learn(rows, whos, np.concatenate(fresh) if fresh else np.zeros(0, np.int64))
    return out.T


# ---- segments


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of these documents, whose tokens stand one after the other."""
    n = len(ids)
    blocks, coded = -(-n // BLOCK), []
    steps = min(n, BLOCK)  # a last block that is shorter than others is filled up with zeros
    for lo in range(0, blocks, LANES):
        own = ids[lo * BLOCK : (lo + LANES) * BLOCK]
        part = np.zeros((-(-len(own) // BLOCK), steps), np.int32)
        part.reshape(-1)[: len(own)] = own
        coded += _encode_lanes(part)
    sums = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(blocks)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = np.array([len(doc_ids), n, blocks, sum(map(len, coded))], "<i8").tobytes()
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.asarray(counts, "<i8").tobytes()
    table = b"".join(np.array(v, "<u4").tobytes() for v in ([len(p) for p in coded], sums))
    return MAGIC + head + index + table + b"".join(coded)


def segments(source):
    """(doc ids, counts, ids) of every segment of a stream; raises where a block's checksum differs."""

    def exactly(n: int) -> bytes:
        parts, left = [], n
        while left:
            part = source.read(left)
            if not part:
                raise ValueError("the file ends inside a segment")
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    while magic := source.read(len(MAGIC)):
        if magic != MAGIC:
            raise ValueError("not a token file")
        docs, n, blocks, size = np.frombuffer(exactly(32), "<i8").tolist()
        doc_ids, known, counts = np.frombuffer(exactly(8 * docs), "<i8"), np.frombuffer(exactly(docs), np.uint8), np.frombuffer(exactly(8 * docs), "<i8")
        coded, sums = (np.frombuffer(exactly(4 * blocks), "<u4").astype(np.int64) for _ in range(2))
        data = np.frombuffer(exactly(size), np.uint8)
        starts = np.cumsum(coded) - coded
        ids = np.zeros(n, np.int32)
        for lo in range(0, blocks, LANES):
            own = ids[lo * BLOCK : (lo + LANES) * BLOCK]
            own[:] = _decode_lanes(data, starts[lo : lo + LANES], min(n, BLOCK)).reshape(-1)[: len(own)]
        for k in range(blocks):
            if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != sums[k]:
                raise ValueError(f"checksum of block {k} differs")
        yield [d if ok else None for d, ok in zip(doc_ids.tolist(), known.tolist(), strict=True)], counts, ids


# ---- tokens of texts


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[tokenizers.Tokenizer, X.Units]:
    return tokenizers.Tokenizer.from_file(path), X.Units()


def token_ids(column: pa.Array, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, each followed by ``END_ID``, and how many each has.

    The tokenizer drops white space and never joins across it, so each distinct word of a batch is encoded once.
    """
    model, units = _tokenizer(path or default_tokenizer())
    data, offsets = X.text_buffer(column)
    starts, ends, first = X.find_words(data, offsets)

    def work_out(data, starts, ends):
        raw = data.tobytes()
        found = model.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], add_special_tokens=False)
        lists = [e.ids for e in found]
        at = np.concatenate([[0], np.cumsum([len(ids) for ids in lists])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int32, at[-1]), at

    ids, count = units.spans(data, starts, ends, work_out)
    upto = np.concatenate([[0], np.cumsum(count)])[first]
    out = np.full(len(ids) + len(offsets) - 1, END_ID, np.int32)
    n = np.diff(upto)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, n + 1


# ---- files


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents (doc_id, text) to token files in ascending doc_id order; returns the manifest (part, file, docs, tokens, bytes), as a table.

    A null text is empty (one token, the end id); a null doc_id comes first; rows that share a doc_id follow
    in the order of their texts. Other columns are ignored; an empty table gives an empty manifest.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    files = max(1, -(-own.count() // ROWS_PER_FILE))
    # Ranges hold all rows of an id, so equal ids stay in one file.
    ranged = own.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.tokens"
        out, total = None, np.zeros(3, np.int64)
        held, held_docs, held_counts = [], [], []

        def flush():
            ids = np.concatenate(held) if held else np.zeros(0, np.int32)
            raw = pack(held_docs, np.concatenate(held_counts), ids)
            out.write(raw)
            total[:] += (len(held_docs), len(ids), len(raw))
            held.clear(), held_docs.clear(), held_counts.clear()

        for batch in X.chunks(batches, limit=CHUNK):
            if out is None:
                out = place.open_output_stream(f"{root}/{name}", compression=None)
            ids, counts = token_ids(batch.column("text"), tokenizer)
            held.append(ids)
            held_counts.append(counts)
            held_docs.extend(batch.column("doc_id").to_pylist())
            if sum(map(len, held)) >= BLOCK * SEGMENT_BLOCKS:
                flush()
        if out is not None:
            if held_docs:
                flush()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [name], "docs": total[:1], "tokens": total[1:2], "bytes": total[2:]})

    return cut_lineage(ranged.mapInArrow(run, "part long, file string, docs long, tokens long, bytes long"))


def read(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read back from the files; start counts the ids of all files and documents before."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before)

    def run(batches):
        place, root = _place(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with place.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for docs, counts, ids in segments(source):
                        end = np.cumsum(counts)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(end.tolist(), counts.tolist(), strict=True)]
                        cols = {"doc_id": pa.array(docs, pa.int64()), "start": start + end - counts, "n_tokens": counts, "ids_crc32": pa.array(sums, pa.int64())}
                        if with_ids:
                            cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(ids))
                        yield pa.RecordBatch.from_pydict(cols)
                        start += len(ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Writes ``docs`` to token files in a new folder beside the session's checkpoints and reads them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer), folder, with_ids)
