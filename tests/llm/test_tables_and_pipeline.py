"""Top-k search, WARC archives, components, registered queries and the pipeline."""

import base64
import gzip
import hashlib
import io
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from beadloom.llm import components, topk, warc

SF_DIR = "/root/testdata/sf0.001"


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_GROUP", 30)
    monkeypatch.setattr(topk, "QUERY_GROUP", 3)
    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, 0.25, -0.5, rng.random()]) for _ in range(rng.choice([0, 5, 8, 8]))]) for k in range(100)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (110, None), (120, [1.0, None]), (130, [math.nan]), (140, [math.inf]), (None, [1.0]), (7, rows[7][1]), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = topk.top_k(topk.integer_vectors(df, "vec_id", "embedding"), F.col("id") % 10 == 0, 4).collect()
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in fine if i % 10 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q))[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    few = df.where("vec_id IN (0, 5)")
    assert topk.top_k(topk.integer_vectors(few, "vec_id", "embedding"), F.col("id") % 10 == 0, 4).count() == 1
    assert topk.top_k(topk.integer_vectors(df.where("false"), "vec_id", "embedding"), F.lit(True), 4).count() == 0


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, least):
    pages = [(5, "http://a", "same text"), (3, "http://b\r\nX: 1", "same text"), (9, None, "same text"), (1, "u", "abc"), (2, "u", "abc"), (4, "u", None), (6, "u", ""), (None, "u", "same text"), (7, "u", "é" * 300_000), (3, "http://b", "same text")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("first", F.lit(1))
    manifest = warc.write(df, str(tmp_path), least)
    rows = warc.read(manifest, str(tmp_path), with_payload=True).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= least and i > first[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, None if again else h or ""))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in rows]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    for name in [r["file"] for r in manifest.collect()]:
        assert gzip.open(tmp_path / name).read().count(b"WARC/1.0\r\n") == next(r["records"] for r in manifest.collect() if r["file"] == name)
    assert warc.archive(df.where("false")).count() == 0


def test_damaged_archives_are_found():
    raw = warc.record(1, "u", b"payload")
    assert [warc.parse(m)[2] for m in warc.members(io.BytesIO(warc.member(raw) * 3))] == [b"payload"] * 3
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"payload", b"payloaD"))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(warc.member(raw)[:-9])))


def test_components(spark):
    rng = random.Random(3)
    edges = [(1000, k) for k in range(60)] + [(2000 + k, 2001 + k) for k in range(25)] + [(rng.randint(100, 500), rng.randint(100, 500)) for _ in range(150)] + [(5, 5), (7777, 7777), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component_id"] for r in components.component_ids(df).collect()} == {n: find(n) for n in parent}
    assert components.component_ids(df.where("false")).count() == 0


# --- registered queries and the pipeline -----------------------------------------

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    from oracle_check import duck

    return duck(SF_DIR)


@pytest.mark.parametrize("name", ["op1_exact_topk", "op2_minhash_near_dedup", "op6_substring_dedup", "op8_warc", "op9_line_dedup"])
def test_queries_match_sql(spark, con, name):
    import __spark_entry__ as entry
    from oracle_check import compare

    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == []


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages_against_brute_force(spark):
    import collections

    import corpus_pipeline
    import sentencepiece
    from test_text_operators import kept_lines, near_duplicate_rows, words, water_fill

    from beadloom.llm import pieces, quality

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    good = stage["quality_rules"](spark, docs, SF_DIR)
    kept = {r["doc_id"] for r in quality.measures(docs).where("kept").collect()}
    assert good.columns == columns and sorted(rows(good)) == sorted(r for r in rows(docs) if r[0] in kept)

    lines = stage["line_dedup"](spark, good, SF_DIR)
    want = [(d, t) for d, n, e, m, t in kept_lines(rows(good)) if n == 0 or e + m < n]
    assert lines.columns == columns and sorted(rows(lines)) == sorted(want)

    single = stage["near_duplicates"](spark, lines, SF_DIR)
    keep = {d for d, _, _, ok in near_duplicate_rows(want) if ok}
    assert single.columns == columns and sorted(rows(single)) == sorted(r for r in want if r[0] in keep)

    mixed = stage["source_mixing"](spark, single, SF_DIR)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in single.collect():
        sizes[r["source"]] += len(words(r["text"]))
    out = mixed.collect()
    for r in out:
        taken[r["source"]] += len(words(r["text"]))
    assert mixed.columns == columns and dict(taken) == {s: math.floor(t + 1e-9) for s, t in water_fill(dict(sizes)).items()}

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoded = stage["sentencepiece"](spark, mixed, SF_DIR).collect()
    assert sorted((r["doc_id"], r["decoded"], r["ids"]) for r in encoded) == sorted((r["doc_id"], r["text"], lib.encode(r["text"])) for r in out)
