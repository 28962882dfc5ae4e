"""Spelling variants by a dictionary of trie-node pairs.

Every prefix of a word is a node of a trie of the words, every suffix one of a trie of the reversed words. A node
has a number: 64 bits that depend on its path alone, so equal prefixes of different words have one number, in
every task, without a pass over the dictionary. A word then stands in the dictionary of pairs (prefix node, suffix node)

- once for each letter, with the node before and the node after it: the word with that letter skipped;
- once for each place between letters, with the nodes that meet there: the word whole.

Two words that differ by one replaced letter share the pair that skips it. A word with one letter more than another has, where it
skips that letter, the pair of the other one at the place where it would be inserted; of a row of equal letters only the first
is skipped for that, so every pair of neighbours meets exactly once. A pair of nodes is shared by no more words
than the alphabet has letters, and one whole word, so no group is large. What meets is compared letter by letter on both sides of the place, so
equal numbers of different paths change nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import text as X

SHORTEST = 7
LEAST = 2
DOMINANCE = 10
LETTERS = r"A-Za-zÀ-ÿ"
SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BATCH_LETTERS = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(n: int) -> np.ndarray:
    """0..n-1 powers of an odd number modulo 2^64."""
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def node_numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the prefix nodes and of the suffix nodes at each of the n + 1 places of each word, and the n of each word."""
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    place = X.expand(sizes)
    power = _powers(int(sizes.max(initial=0)) + 1)
    own = X.mix(letters + _U(1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(begin[:-1], sizes + 1) + X.expand(sizes + 1)
    first, end = np.repeat(begin[:-1], sizes + 1), np.repeat(begin[1:], sizes + 1)
    ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[place], dtype=np.uint64)])
    back = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[np.repeat(sizes, sizes) - 1 - place], dtype=np.uint64)])
    forward = X.mix((ahead[at] - ahead[first]) + _U(_BASE) * (at - first).astype(np.uint64))
    reverse = X.mix((back[end] - back[at]) ^ _U(0x5851F42D4C957F2D) * (end - at + 1).astype(np.uint64))
    return forward, reverse, sizes


def _pairs(batches):
    """(prefix, suffix, place, whole, first, id): the dictionary rows of words (id, word)."""
    for batch in X.chunks(batches, "word", BATCH_LETTERS):
        words = batch.column("word").to_pylist()
        ids = batch.column("id").to_numpy()
        forward, reverse, sizes = node_numbers(words)
        owner, place = np.repeat(np.arange(len(words)), sizes + 1), X.expand(sizes + 1)
        letter = np.flatnonzero(place < sizes[owner])  # the places with a letter after them
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        new[place[letter] == 0] = True
        n = len(letter)
        for k in range(0, max(n, len(place)), BATCH_LETTERS):
            s, w = letter[k : k + BATCH_LETTERS], slice(k, k + BATCH_LETTERS)
            yield pa.RecordBatch.from_pydict(
                {
                    "prefix": X.signed(np.concatenate([forward[s], forward[w]])),
                    "suffix": X.signed(np.concatenate([reverse[s + 1], reverse[w]])),
                    "place": np.concatenate([place[s], place[w]]).astype(np.int32),
                    "whole": np.concatenate([np.zeros(len(s), bool), np.ones(len(place[w]), bool)]),
                    "first": np.concatenate([new[w][: len(s)], np.zeros(len(place[w]), bool)]),
                    "id": np.concatenate([ids[owner[s]], ids[owner[w]]]),
                }
            )


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of all pairs of ``words`` (word, n; distinct) that differ by one letter.

    One letter is inserted, deleted or replaced. Words of any length take part; an empty word is near those of one letter.
    Nulls take no part; other columns are ignored.
    """
    stored = cut_lineage(words.where("word IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    schema = "prefix long, suffix long, place int, whole boolean, first boolean, id long"
    rows = cut_lineage(stored.select("id", "word").mapInArrow(_pairs, schema))
    skips, wholes = rows.where("NOT whole"), rows.where("whole")
    a = skips.select("prefix", "suffix", F.col("place").alias("at"), F.col("id").alias("a"), "first")
    b = skips.select("prefix", "suffix", F.col("id").alias("b"))
    replaced = a.join(b, ["prefix", "suffix"]).where("a < b").select("a", "b", "at", F.lit(1).alias("skip"))
    b = wholes.select("prefix", "suffix", F.col("id").alias("b"))
    inserted = a.where("first").join(b, ["prefix", "suffix"]).select("a", "b", "at", F.lit(0).alias("skip"))
    met = replaced.unionByName(inserted)
    met = met.join(stored.toDF("a", "wa", "na"), "a").join(stored.toDF("b", "wb", "nb"), "b")
    # place by place, so that numbers shared by different paths are of no consequence
    same = (
        (F.substring("wa", F.lit(1), F.col("at")) == F.substring("wb", F.lit(1), F.col("at")))
        & (F.expr("substring(wa, at + 2)") == F.expr("substring(wb, at + 1 + skip)"))
        & (F.col("wa") != F.col("wb"))
    )
    met = met.where(same)
    both = F.explode(
        F.array(
            F.struct(F.col("wa").alias("word"), F.col("wb").alias("near"), F.col("nb").alias("near_n")),
            F.struct(F.col("wb").alias("word"), F.col("wa").alias("near"), F.col("na").alias("near_n")),
        )
    )
    return met.select(both.alias("p")).select("p.*")


def group_variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; distinct words).

    ``n_near`` counts the words that differ by one letter. ``form`` is the one of them with the largest n, of several the
    first in code-point order, if its n is at least ``dominance`` times that of the word, else null; ``form_n`` is its n. ``root`` is
    where following forms ends, the word itself if it has none. A null word is left out; no words give no rows.
    """
    own = cut_lineage(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    near = near_words(own)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    is_form = -F.col("best.m") >= dominance * F.col("n")
    formed = cut_lineage(
        own.join(best, "word", "left").select(
            "word", F.when(is_form, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n")
        )
    )
    # n grows along forms, so paths end; each round doubles the number of forms followed
    ahead = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        ahead = cut_lineage(ahead)
        further = ahead.select(F.col("word").alias("to"), F.col("to").alias("next"))
        if ahead.join(further, "to", "leftsemi").isEmpty():
            break
        ahead = ahead.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"))
    return formed.join(ahead, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def _counts(shortest: int, misspell):
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def run(batches):
        for batch in X.chunks(batches):
            total: Counter = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = Counter(runs.findall((text or "").encode().translate(SMALL).decode()))
                if misspell is None:
                    total.update(own)
                else:
                    for word, n in own.items():
                        total[misspell(doc_id, word)] += n
            total = {w: n for w, n in total.items() if len(w) >= shortest}
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def drop_letter(doc_id, word: str, every: int = 31) -> str:
    """A word that loses a letter where the checksum of document and word says so; never in a document without an id."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every or doc_id is None:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, misspell=None) -> DataFrame:
    """(word, n): maximal runs of letters of all texts of ``docs`` (doc_id, text), A-Z made small, and how often each occurs.

    Runs have ``shortest`` letters or more, words ``least`` occurrences or more. ``misspell(doc_id, run)`` may give another word
    for a run; if that is shorter than ``shortest`` it is not counted. Counts are added up in chunks of texts before
    the shuffle. A null or empty text has no words; repeated rows count each time; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = own.mapInArrow(_counts(shortest, misspell), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
