"""Benchmark decontamination, periodic runs and spelling variants against brute force, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beadloom.llm import decontaminate, periodic, queries, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, docs):
    """Documents with columns of names that the operators use themselves."""
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOC)
    return df.withColumn("items", F.lit("x")).withColumn("ranges", F.lit(1)).withColumn("runs", F.lit(2)).withColumn("id", F.lit(-1)).withColumn("n", F.lit(7))


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- decontamination --------------------------------------------------------------------


def brute_hits(text, items, window):
    """(n_words, hit word numbers, item ids as strings) by looking at every place."""
    own = TERM.findall(small(text))
    hit, names = set(), set()
    for item, question in items:
        q = TERM.findall(small(question))
        k = min(window, len(q))
        wins = {tuple(q[a : a + k]) for a in range(len(q) - k + 1)} if k else set()
        for a in range(len(own) - k + 1) if wins and item is not None else ():
            if tuple(own[a : a + k]) in wins:
                hit.update(range(a, a + k))
                names.add(str(item))
    return len(own), hit, sorted(names)


def brute_spans(text, hit):
    lowered = [(m.start(), m.end()) for m in TERM.finditer(small(text))]
    spans = []
    for k in sorted(hit):
        if spans and k - 1 in hit:
            spans[-1] = (spans[-1][0], lowered[k][1])
        else:
            spans.append(lowered[k])
    return spans


@pytest.mark.parametrize("limit", [decontaminate.AUTOMATON_CHARS, 60])
def test_hits_are_those_of_every_window(spark, limit):
    rng = random.Random(11)
    vocabulary = ["a", "B", "cC", "Ñu", "日本", "x9", "\U0001f980z", "the"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 9])))) for k in range(12)]
    items += [(12, None), (13, ""), (14, " .!"), (3, "the the the the the the"), (None, "a a"), (15, items[4][1]), (100, "b B, b...B\nb")]
    docs = []
    for k in range(120):
        own = rng.choices(vocabulary, k=rng.randint(0, 40))
        if rng.random() < 0.6:
            at = rng.randint(0, len(own))
            own[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((k, "".join(w + rng.choice([" ", ", ", "\n", "-", "\x00", "_ "]) for w in own)))
    docs += [(200, None), (201, ""), (202, " ?? "), (None, docs[7][1]), (203, docs[3][1]), (203, docs[3][1]), (204, "the " * 30_000)]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("piece", F.lit(1))
    got = decontaminate.find_contamination(frame(spark, docs), table, window=5, limit=limit).collect()
    assert len(got) == len(docs)
    want = collections.Counter()
    for d, t in docs:
        n, hit, names = brute_hits(t, items, 5)
        want[(d, n, len(hit), tuple(names), tuple(brute_spans(t, hit)))] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in got) == want


def test_empty_tables_have_no_hits(spark):
    docs = frame(spark, [(1, "some words"), (2, None)])
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.find_contamination(docs.where("false"), items).count() == 0
    got = decontaminate.find_contamination(docs, items.where("false")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in got) == [(1, 2, 0, [], []), (2, 0, 0, [], [])]


def test_long_items_are_whole_over_their_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    item = [f"w{k}" for k in range(100)]
    docs = [(k, " ".join(item[k : k + 10])) for k in range(91)] + [(500, " ".join(item[5:14])), (501, " ".join(item))]
    table = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_contamination(frame(spark, docs), table).collect()}
    assert got == {k: 10 for k in range(91)} | {500: 0, 501: 100}


# --- periodic runs -----------------------------------------------------------------------


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


pattern = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)).map(lambda p: p[0] * p[1])


@settings(max_examples=400, deadline=None)
@given(st.lists(pattern, max_size=8).map(lambda parts: [x for p in parts for x in p]))
def test_runs_are_those_of_every_period(words):
    got = periodic.find_runs(np.array([*words, 99], np.int64), len(words))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(pattern, min_size=1, max_size=6).map(lambda parts: [x for p in parts for x in p]), st.data())
def test_extensions_are_those_of_the_sequence(words, data):
    grammar = periodic.Grammar(np.array(words, np.int64))
    places = st.integers(0, len(words))
    pairs = [p for p in data.draw(st.lists(st.tuples(places, places), max_size=30)) if p[0] != p[1]]
    i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    right, left = grammar.extension(i, j, True).tolist(), grammar.extension(i, j, False).tolist()
    for k, (a, b) in enumerate(pairs):
        ahead = next((n for n in range(len(words)) if max(a, b) + n >= len(words) or words[a + n] != words[b + n]), 0)
        back = next(n for n in range(len(words) + 1) if min(a, b) - n <= 0 or words[a - n - 1] != words[b - n - 1])
        assert (right[k], left[k]) == (ahead, back)


def test_runs_of_texts(spark):
    rng = random.Random(12)
    docs = [(k, " ".join("\n".join(rng.choices("abc", k=rng.randint(1, 4))) + " " for _ in range(1)) * rng.randint(0, 12) + " ".join(rng.choices("abcdé", k=30))) for k in range(80)]
    docs += [(100, None), (101, ""), (102, " \n"), (103, "x " * 50_000), (104, "one two three " * 9_000 + "end"), (None, "ab " * 7), (105, "ab " * 7), (105, "ab " * 7)]
    got = periodic.periodic_runs(frame(spark, docs)).collect()
    want = collections.Counter()
    for d, t in docs:
        w = (t or "").split()
        runs = [(0, 50_000, 1)] if d == 103 else [(0, 27_000, 3)] if d == 104 else brute_runs(w)
        want[(d, len(w), tuple(runs), brute_collapsed(w, runs))] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in got) == want
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


def test_many_mismatched_candidates_are_whole():
    words = [x for k in range(3000) for x in (0, 1, 2, 3, 10 + k)] + [7, 8, 9] * 400
    got = periodic.find_runs(np.array([*words, 10**6], np.int64), len(words))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(15_000, 1200, 3)]


def test_op12_by_its_contract(spark, tmp_path):
    rng = random.Random(13)
    docs = [(k, " ".join(rng.choices(["to", "be", "or", "not"], k=rng.randint(0, 60)))) for k in range(300)] + [(301, None), (302, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for d, t in docs:
        w = (t or "").split()
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[d] == {
            "doc_id": d, "n_runs": len(runs), "start": s, "length": n, "period": q, "exponent_milli": None if n is None else 1000 * n // q,
            "runs_sha256": sha("".join(f"{x},{y},{z}\n" for x, y, z in runs)), "collapsed_sha256": sha(brute_collapsed(w, runs)),
        }
    assert planted > 10


# --- spelling variants ------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        own = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form[w] = own[0][1] if own and -own[0][0] >= 10 * n else None
        out[w] = (form[w], n, len(own), -own[0][0] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_are_those_of_all_pairs(spark):
    rng = random.Random(14)
    counts = {"": 5, "a": 60, "é": 7}
    for _ in range(400):
        w = "".join(rng.choices("abé\U0001f980", k=rng.randint(1, 7)))
        counts[w] = rng.choice([1, 1, 2, 9, 10, 90, 100, 1000, 10_000, 100_000])
    long = "ab" * 40_000
    want = brute_variants(counts)
    want |= {long: (None, long, 50, 1, None), long[:999] + long[1000:]: (long, long, 3, 1, 50)}
    words = spark.createDataFrame([*counts.items(), (long, 50), (long[:999] + long[1000:], 3), (None, 4)], "word string, n long")
    words = words.withColumn("id", F.lit(1)).withColumn("near", F.lit("x"))
    assert result(spelling.group_variants(words)) == want
    assert spelling.group_variants(words.where("false")).count() == 0
    assert any(v[1] not in (w, v[0]) for w, v in want.items())  # forms of forms


def test_op13_by_its_contract(spark, tmp_path):
    rng = random.Random(15)
    vocabulary = ["Wonderful", "wonderful", "WONDERFULL", "straßenfest", "Éclatant", "éclatant", "eclatant", "naïveté", "naïvetés", "short", "seventh", "seventhx"]
    docs = []
    for k in range(400):
        own = [rng.choice(vocabulary[:3] * 9 + vocabulary) for _ in range(rng.randint(0, 20))]
        own = [w if rng.random() < 0.95 else w[:3] + rng.choice("aeiou") + w[4:] for w in own]
        docs.append((k, "".join(w + rng.choice([" ", "1", ", ", "ō", "\n"]) for w in own)))
    docs += [(500, None), (501, ""), (502, docs[3][1]), (502, docs[3][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = small(run)
            h = zlib.crc32(f"{d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = result(queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path)))
    assert got == brute_variants(counts) and any(v[0] for v in got.values())


def test_documents_without_an_id_keep_their_words(spark):
    docs = frame(spark, [(None, "something " * 200)])
    assert [tuple(r) for r in spelling.count_words(docs, misspell=spelling.drop_letter).collect()] == [("something", 200)]
