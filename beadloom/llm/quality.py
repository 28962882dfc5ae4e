"""Quality rules: surface counts and tokeniser fertility.

The surface rule rejects texts of under 20 words and texts of which over 30 % of the words lie in repeated
8-word windows. The fertility rule encodes the whole text with a public vocabulary and looks at characters
per token, the share of byte-fallback tokens and the entropy of the tokens, each against a band of the
document's language. Bands are parameters; the default ones are wide, so that they reject only text that the
vocabulary hardly covers (encoded data, broken characters, symbol noise, a few tokens over and over). The floor of the
entropy grows with the length of the text, as a short text cannot have many different tokens. A text that is mostly in another
script than its language takes the band of texts without one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from . import text as X

MIN_WORDS = 20
REPEAT_WORDS, REPEAT_PERCENT = 8, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LEAD = np.zeros(256, np.int8)  # by first byte of a code point: 1 Latin letters (up to U+024F), 2 letters of other scripts, 0 the rest
_LEAD[65:91] = _LEAD[97:123] = _LEAD[0xC3:0xCA] = 1
_LEAD[0xCA:0xE2] = _LEAD[0xE3:0xEF] = 2


@dataclass(frozen=True)
class Band:
    """Limits, inclusive; ``least_entropy`` in bits, compared with min(least_entropy, ENTROPY_SHARE * log2(tokens)).

    The default share and floor lie below all of the 17,242 rows labelled good that the surface rule keeps in a table of
    51,282 documents: their entropy is at least 0.46 of log2(tokens), and at least 4.79 bits.
    """

    chars_per_token: tuple[float, float] = (1.0, 12.0)
    most_byte_share: float = 0.30
    least_entropy: float = 4.0


ENTROPY_SHARE = 0.35
#: Scripts outside the Latin letters take more tokens and bytes for a character.
LATIN = frozenset(("en", "de", "fr", "es"))
BANDS = {
    "en": Band((1.3, 12.0), 0.10),
    "de": Band((1.2, 12.0), 0.10),
    "fr": Band((1.2, 12.0), 0.10),
    "es": Band((1.2, 12.0), 0.10),
    "zh": Band((0.25, 6.0), 0.90),
    "ja": Band((0.25, 6.0), 0.90),
    "ko": Band((0.25, 6.0), 0.90),
}
OTHER = Band((0.25, 12.0), 0.90)


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, how many words lie in ``REPEAT_WORDS``-word windows that it has twice or more."""
    count = np.diff(first)
    full = np.maximum(count - REPEAT_WORDS + 1, 0)
    at = np.repeat(first[:-1], full) + X.expand(full)
    owner = np.repeat(np.arange(len(count)), full)
    grams = X.gram_hashes(hashes, REPEAT_WORDS)[at]
    key = X.mix(grams + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    g, o = grams[order], owner[order]
    same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + REPEAT_WORDS, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, how many lines with a word equal an earlier line."""
    out = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    for k in range(len(out)):
        lines = [line for line in raw[offsets[k] : offsets[k + 1]].split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
        out[k] = len(lines) - len(set(lines))
    return out


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _entropy(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    key = np.sort(owner << 20 | ids)
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    n = np.diff(edges).astype(float)
    part = np.bincount(key[edges[:-1]] >> 20, n * np.log2(n), minlength=len(size)) if len(key) else np.zeros(len(size))
    safe = np.maximum(size, 1)
    return np.maximum(np.log2(safe) - part / safe, 0.0)


def _judge(batch: pa.RecordBatch, fst: pieces.Transducer, bands: dict[str, Band], other: Band) -> dict:
    is_byte = np.zeros(len(fst.kinds), bool)
    if fst.byte_ids is not None:
        is_byte[fst.byte_ids] = True
        is_byte[fst.byte_ids[9:14]] = False  # line breaks and tabs
    data, offsets = X.text_buffer(batch.column("text"))
    starts, ends, first = X.find_words(data, offsets)
    n_words = np.diff(first)
    repeated = _repeated_words(X.hash_spans(data, starts, ends), first)
    chars = _sums(~X.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    ids, at = fst.encode(batch.column("text"))
    n_tokens = np.diff(at)
    some = np.maximum(n_tokens, 1)
    fertility, share, entropy = chars / some, _sums(is_byte[ids], at) / some, _entropy(ids.astype(np.int64), at)
    lead = _LEAD[data]
    latin, letters = _sums(lead == 1, offsets), _sums(lead > 0, offsets)
    own = ((2 * latin >= letters) | (letters == 0)).tolist()  # most letters are Latin ones
    of = [bands.get(x, other) if own[k] == (x in LATIN) else other for k, x in enumerate(batch.column("lang").to_pylist())]
    low, high = np.array([b.chars_per_token[0] for b in of]), np.array([b.chars_per_token[1] for b in of])
    inside = (fertility >= low) & (fertility <= high) & (share <= np.array([b.most_byte_share for b in of]))
    inside &= entropy >= np.minimum(np.array([b.least_entropy for b in of]), ENTROPY_SHARE * np.log2(some))
    failed = (n_words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_dup_lines": _repeated_lines(data, offsets),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": ~failed & ((n_tokens == 0) | inside),
        "n_tokens": n_tokens,
        "chars_per_token": fertility,
        "byte_share": share,
        "entropy": entropy,
    }


def measures(docs: DataFrame, bands: dict[str, Band] | None = None, other: Band = OTHER, model: str | None = None) -> DataFrame:
    """(doc_id, the counts, the fertility figures, base_failed, kept) for every row of ``docs`` (doc_id, text, lang).

    A null text counts as empty: no words, base_failed. A null or unlisted language takes the band ``other``.
    A text without tokens has 0 for its fertility figures and is judged by the surface rule alone. Repeated
    rows and ids each get their row; other columns are ignored; an empty table gives no rows.
    """
    bands = BANDS if bands is None else bands

    def run(batches):
        fst = pieces.load(model)
        for batch in X.chunks(batches, limit=pieces.CHUNK):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **_judge(batch, fst, bands, other)})

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, entropy double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, bands: dict[str, Band] | None = None, other: Band = OTHER, model: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are; every row is judged by its own text."""
    bands = BANDS if bands is None else bands

    def run(batches):
        fst = pieces.load(model)
        for batch in X.chunks(batches, limit=pieces.CHUNK):
            yield batch.filter(pa.array(_judge(batch, fst, bands, other)["kept"]))

    return docs.mapInArrow(run, docs.schema)
