"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

The sketch has ``t`` coordinates. Round ``i < t`` hashes every element of the set to a bin and a value,
round ``t + i`` puts every element in bin ``i``; a coordinate is the least (round, value) that its bin
received, and rounds end when every bin is filled. So every coordinate is filled after at most ``2 t``
rounds, equal coordinates estimate the Jaccard similarity, and the estimate is concentrated as with
independent ones.

64 bands of 4 coordinates miss a pair of similarity 0.75 with probability (1 - 0.75**4)**64 = 3e-11.
Candidates are settled on the full sets, in two steps that lose no candidate link: first every member
of a band bucket against the bucket's smallest id; then, in buckets whose members are still in several
components, the pairs across components. The second step makes rows of pairs in small buckets only; large
buckets are cut into tiles of bounded size, none of them inside the bucket's largest component, and a tile's task compares sets and returns the links that join
components. Copies with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import text as X
from .components import component_ids

WORDS = 5
PERCENT = 75
COORDS, ROWS = 256, 4
BITS = 64 * (COORDS // 64)
#: At similarity 0.75 at least BITS * 0.875 = 224 one-bit coordinates agree on average, with a deviation of 5.3.
LEAST_AGREEING = 190
#: Buckets up to this size give rows of pairs; larger ones are cut into blocks of about so many documents.
SMALL, TILE = 8, 512

_U = np.uint64
_TOP = _U((1 << 64) - 1)


def shingle_sets(batch: pa.RecordBatch, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch, and the n + 1 offsets."""
    data, offsets = X.text_buffer(batch.column("text"))
    data = X.LOWER[data]
    starts, ends, first = X.find_words(data, offsets)
    hashes = X.hash_spans(data, starts, ends)
    count = np.diff(first)
    grams = X.gram_hashes(hashes, words)
    full = np.maximum(count - words + 1, 0)
    at = np.repeat(first[:-1], full) + X.expand(full)
    values, owner = grams[at], np.repeat(np.arange(len(count)), full)
    short = np.flatnonzero((count > 0) & (count < words))
    whole = np.zeros(len(short), np.uint64)
    for k in range(1, words):
        of = count[short] == k
        if of.any():
            whole[of] = X.gram_hashes(hashes, k)[first[:-1][short[of]]]
    values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def sketch(values: np.ndarray, offsets: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of each non-empty set (``coords`` a power of two); empty sets keep the top value."""
    size = np.diff(offsets)
    out = np.full((len(size), coords), _TOP)
    flat = out.reshape(-1)
    shift = _U(64 - coords.bit_length() + 1)
    owner = np.repeat(np.arange(len(size)), size)
    left = np.full(len(size), coords)
    for turn in range(2 * coords):
        if not len(values):
            break
        h = X.mix(values ^ X.mix(np.array([turn + 1], np.uint64)))
        slot = owner * coords + ((h >> shift).astype(np.int64) if turn < coords else turn - coords)
        open_ = flat[slot] == _TOP if turn else np.ones(len(slot), bool)
        slot = slot[open_]
        np.minimum.at(flat, slot, (h[open_] & _U((1 << 48) - 1)) | _U(turn << 48))
        fresh = np.unique(slot)
        left -= np.bincount(fresh // coords, minlength=len(size))
        more = left[owner] > 0
        values, owner = values[more], owner[more]
    return out


def band_keys(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each ``rows`` neighbouring coordinates, different between bands."""
    bands = sketches.shape[1] // rows
    part = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(X.mix(np.arange(1, bands + 1, dtype=np.uint64)), part.shape[:2])
    for k in range(rows):
        key = X.mix(key * _U(0x9E3779B97F4A7C15) + part[:, :, k])
    return key


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.chunks(batches):
        values, offsets = shingle_sets(batch)
        size = np.diff(offsets)
        seeds = np.array([0x51, 0xA7], np.uint64)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(values ^ X.mix(seeds[k : k + 1])))]) for k in range(2)]
        keys = [X.signed(s[offsets[1:]] - s[offsets[:-1]]) for s in sums]
        s = sketch(values, offsets)
        bits = np.packbits((X.mix(s) & _U(1)).astype(np.uint8), axis=1).view("<i8")
        bands = X.signed(np.ascontiguousarray(band_keys(s)))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1)))
        cols = {"doc_id": batch.column("doc_id"), "n_shingles": size.astype(np.int64), "k1": keys[0], "k2": keys[1], "bands": bands}
        cols |= {f"s{k}": np.ascontiguousarray(bits[:, k]) for k in range(bits.shape[1])}
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.chunks(batches):
        values, offsets = shingle_sets(batch)
        sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(X.signed(values)))
        yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id"), "shingles": sets})


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands, s0..): one row per row of ``docs``; k1, k2 identify the set."""
    words = ", ".join(f"s{k} long" for k in range(BITS // 64))
    schema = f"doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, {words}"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch_batches, schema)


def _agree() -> F.Column:
    return F.lit(BITS) - sum(F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(BITS // 64))


def _similar_sizes() -> F.Column:
    return (F.least("x.n", "y.n") * 100) >= (F.greatest("x.n", "y.n") * PERCENT)


def _linked(pairs: DataFrame, slim: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    x, y = slim.alias("x"), slim.alias("y")
    hopeful = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(_similar_sizes() & (_agree() >= LEAST_AGREEING))
    both = hopeful.select("a", "b").distinct().join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * PERCENT).select("a", "b").distinct()


def _tiles(many: DataFrame) -> DataFrame:
    """(key, lo, hi, id, c, block): the tiles of the buckets ``many`` (key, id, c); two ids of different components meet in one tile of a bucket."""
    # Members of a bucket's largest component are linked already, so their blocks meet only blocks of the others: a bucket of one large
    # component and few others makes rows in proportion to its size.
    parts = many.groupBy("key", "c").agg(F.count("*").alias("_n")).groupBy("key").agg(F.max(F.struct("_n", "c")).alias("_big"), F.sum("_n").alias("_m"))
    blocks = lambda n: F.ceil(n / TILE).cast("long")
    dealt = many.select("key", "id", "c").join(parts.select("key", F.col("_big.c").alias("_c"), blocks(F.col("_m") - F.col("_big._n")).alias("_rest"), blocks(F.col("_big._n")).alias("_own")), "key")
    big = F.col("c") == F.col("_c")
    block = F.when(big, F.col("_rest") + F.pmod(F.xxhash64("id"), F.col("_own"))).otherwise(F.pmod(F.xxhash64("id"), F.col("_rest")))
    others = F.when(big, F.col("_rest")).otherwise(F.col("_rest") + F.col("_own")) - 1
    tiles = dealt.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), others)))
    return tiles.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "id", "c", "block")


def _tile_links(key, table: pa.Table) -> pa.Table:
    """Links across components among the documents of one tile, enough of them to join what they join.

    A pair of documents that share several buckets is looked at in that of their first common band alone.
    """
    m = table.num_rows
    get = lambda c: table.column(c).to_numpy()
    ids, n, block, comp = get("id"), get("n"), get("block"), get("c")
    signs = np.stack([get(f"s{k}").view(np.uint64) for k in range(BITS // 64)], 1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(m, -1)
    lists = table.column("shingles").combine_chunks()
    flat, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    here = int(np.flatnonzero((bands == bands[0]).all(0))[0]) if m > 1 else 0
    across = key[1].as_py() != key[2].as_py()
    found = []
    for a in range(m):
        other = np.flatnonzero((comp != comp[a]) & (ids > ids[a]) & (100 * np.minimum(n, n[a]) >= PERCENT * np.maximum(n, n[a])))
        if across:
            other = other[block[other] != block[a]]
        other = other[BITS - np.bitwise_count(signs[other] ^ signs[a]).sum(1, dtype=np.int64) >= LEAST_AGREEING]
        other = other[(bands[other, :here] != bands[a, :here]).all(1)] if here else other
        if not len(other):
            continue
        mine = np.sort(flat[bounds[a] : bounds[a + 1]])
        size = bounds[other + 1] - bounds[other]
        theirs = flat[np.repeat(bounds[other], size) + X.expand(size)]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        for b in other[100 * common >= PERCENT * (len(mine) + size - common)]:
            if comp[a] != comp[b]:
                found.append((ids[a], ids[b]))
                comp = np.where(comp == comp[b], comp[a], comp)
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Null or blank texts have the empty set and are linked with nothing. A null doc_id is linked with
    nothing either: component_id is null and kept true. Rows that share a doc_id are one node, linked
    with whatever one of them is linked with. Other columns are ignored; an empty table gives no rows.
    """
    all_sets = cut_lineage(sketches(docs))
    live = all_sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["n_shingles", "k1", "k2"]
    copies = cut_lineage(live.groupBy(key).agg(F.min("doc_id").alias("id")))
    signs = [f"s{k}" for k in range(BITS // 64)]
    nodes = live.join(copies, [*key]).where("doc_id = id").dropDuplicates(["id", *key])
    nodes = cut_lineage(nodes.select("id", F.col("n_shingles").alias("n"), "bands", *signs))
    members = nodes.select(F.explode("bands").alias("key"), "id")
    hubs = members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"))
    crowded = cut_lineage(members.join(hubs.where("hub < top").select("key", "hub"), "key"))
    inside = crowded.select("id").distinct()
    slim = cut_lineage(nodes.join(inside, "id", "leftsemi"))
    # Sets are rebuilt from the texts that share a bucket, so that the sets of all others are never stored.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut_lineage(own.join(inside.toDF("doc_id"), "doc_id", "leftsemi").mapInArrow(_set_batches, "id long, shingles array<long>"))
    links = cut_lineage(_linked(crowded.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), slim, sets))
    same = live.join(copies, key).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a != b")
    found = component_ids(links.union(same))

    # What is left: buckets whose members are in several components.
    labelled = crowded.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c"))
    open_ = labelled.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("key", "m")
    side = cut_lineage(labelled.join(open_, "key"))
    few, many = side.where(F.col("m") <= SMALL), side.where(F.col("m") > SMALL)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")))
    more = _linked(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), slim, sets)
    tiles = _tiles(many).join(slim.select("id", "n", "bands", *signs), "id").where(F.array_contains("bands", F.col("key"))).join(sets, "id")
    links = cut_lineage(links.union(more).union(tiles.groupBy("key", "lo", "hi").applyInArrow(lambda key, tile: _tile_links(key, tile), "a long, b long")))

    found = component_ids(links.union(same))
    out = all_sets.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.coalesce(own_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its group; other columns as they are."""
    lost = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == F.col("__lost"), "leftanti")
