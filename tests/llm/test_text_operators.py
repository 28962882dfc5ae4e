"""The operators on whole texts against brute force, and their edge cases."""

import collections
import hashlib
import io
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beadloom.llm import line_dedup, minhash, mixing, pieces, pii, quality, substring, token_codec
from beadloom.llm import text as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, docs, clash=True):
    """Documents with all their columns, and columns of names that the operators use themselves."""
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOC)
    return df.withColumn("kept", F.lit("x")).withColumn("id", F.lit(-1)).withColumn("hash", F.lit(None).cast("string")) if clash else df


def words(text):
    return WORD.findall(text or "")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) if not isinstance(x, bool) else (True, int(x)) for x in r))


# --- kernels -----------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \t\né漢\x0b."), max_size=30), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = X.text_buffer(pa.array(texts, pa.string()))
    starts, ends, first = X.find_words(data, offsets)
    raw = data.tobytes()
    got = [[raw[starts[k] : ends[k]].decode() for k in range(first[n], first[n + 1])] for n in range(len(texts))]
    assert got == [words(t) for t in texts]


def test_equal_spans_and_grams_have_equal_hashes():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abc", k=rng.choice([1, 7, 8, 9, 16, 17, 600]))) for _ in range(40)]
    text = " ".join(rng.choices(vocabulary, k=500))
    data, offsets = X.text_buffer(pa.array([text]))
    starts, ends, _ = X.find_words(data, offsets)
    h = X.hash_spans(data, starts, ends)
    own = text.split()
    for size in (1, 2, 3, 5, 8, 25):
        g = X.gram_hashes(h, size)
        assert len(g) == len(own) - size + 1
        seen = collections.defaultdict(set)
        for k, v in enumerate(g.tolist()):
            seen[tuple(own[k : k + size])].add(v)
        assert all(len(v) == 1 for v in seen.values()) and len(set(g.tolist())) == len(seen)


# --- near-duplicates ----------------------------------------------------------


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def near_duplicate_rows(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets]


def near_copies(seed, n, edits, size=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = rng.choices(vocabulary, k=size)
    docs = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.choice(edits)):
            own[rng.randrange(size)] = rng.choice(vocabulary)
        docs.append((k, " ".join(own)))
    return docs, rng, vocabulary


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    docs, rng, vocabulary = near_copies(4, 150, [0, 1, 2, 3, 4, 5, 6, 8, 12])
    docs += [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for k in range(150, 190)]
    docs += [(200, docs[5][1]), (201, docs[5][1].upper()), (202, None), (None, docs[5][1]), (203, " \n"), (7, docs[160][1]), (5, docs[5][1])]
    got = [tuple(r) for r in minhash.near_duplicates(frame(spark, docs)).collect()]
    assert ordered(got) == ordered(near_duplicate_rows(docs))


def test_members_of_the_largest_component_are_not_copied_to_each_other(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    rows = [(1, k, 1 if k < 100 else k) for k in range(103)] + [(2, k, k % 4) for k in range(40)]
    tiles = minhash._tiles(spark.createDataFrame(rows, "key long, id long, c long")).collect()
    assert sum(x.key == 1 for x in tiles) < 160  # 1,339 where all blocks meet all
    met = {}
    for x in tiles:
        met.setdefault((x.key, x.lo, x.hi), []).append(x)
    pairs = [(key, *sorted((a.id, b.id))) for (key, lo, hi), own in met.items() for a in own for b in own if a.id < b.id and a.c != b.c and (lo == hi or a.block != b.block)]
    want = {(key, a, b) for key, a, c in rows for other, b, d in rows if key == other and a < b and c != d}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_tiles_find_what_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "TILE", 8)
    docs, _, _ = near_copies(9, 90, [2, 3, 4, 5, 6])
    got = [tuple(r) for r in minhash.near_duplicates(frame(spark, docs)).collect()]
    assert ordered(got) == ordered(near_duplicate_rows(docs))


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [base, np.concatenate([base[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)]), base[:1], base[:6]]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = minhash.sketch(np.concatenate(sets), offsets)
    assert (s != minhash._TOP).all()
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.12
    assert (minhash.sketch(base[::-1].copy(), np.array([0, 400])) == s[:1]).all()


def test_one_of_each_group_stays_with_its_columns(spark):
    docs = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y"), (4, None)]
    out = minhash.keep_one(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]
    assert minhash.near_duplicates(frame(spark, []).where("false")).count() == 0


# --- substring dedup -------------------------------------------------------------


def repeats(docs, size):
    seen, out = {}, []
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1 if d is not None else 0):
            key = tuple(w[k : k + size])
            seen[key] = min(seen.get(key, d), d)
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1 if d is not None else 0):
            if seen[tuple(w[k : k + size])] < d:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, lost in zip(w, gone) if not lost)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("size", [7, 50, 130])
def test_passages_equal_brute_force(spark, size):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    passages = [rng.choices(vocabulary, k=n) for n in (60, 120, 49, 50, 51, 300)]
    docs = []
    for k in range(80):
        own = []
        for _ in range(rng.randint(0, 4)):
            own += rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(0, 80))
        docs.append((k, " ".join(own)))
    docs += [(200, docs[7][1]), (201, docs[7][1]), (7, docs[9][1]), (202, None), (None, docs[9][1]), (203, docs[7][1]), (203, docs[20][1]), (204, " ".join(["a"] * 500)), (205, "a " * 70)]
    got = [tuple(r) for r in substring.remove_repeats(frame(spark, docs).withColumn("gone", F.lit(1)), size).collect()]
    assert ordered(got) == ordered(repeats(docs, size))
    assert substring.levels(50) == [25, 50] and all(2 * a >= b for a, b in zip(substring.levels(900), substring.levels(900)[1:]))


# --- line dedup ---------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def kept_lines(docs):
    lines = [(d, n, line) for d, t in docs for n, line in enumerate((t or "").split("\n")) if t is not None and words(line)]
    lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first = {}
    for d, n, line in lines:
        first.setdefault(line, (d is not None, d or 0, n))
    near = {a for a in first for b in first if first[b] < first[a] and max(len(a), len(b)) >= line_dedup.MIN_CHARS and within_one(a, b)}
    out = []
    for d, t in docs:
        own = (t or "").split("\n") if t is not None else []
        full = [k for k, line in enumerate(own) if words(line)]
        n_near = [k for k in full if own[k] in near]
        equal = [k for k in full if own[k] not in near and (d is not None, d or 0, k) > first[own[k]]]
        kept = None if t is None else "\n".join(line for k, line in enumerate(own) if k not in n_near + equal)
        out.append((d, len(full), len(equal), len(n_near), kept))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choices("abcdé ", k=n)) for n in (5, 18, 19, 20, 21, 40, 63, 64, 65, 66, 128, 129, 300) for _ in range(3)]
    docs = []
    for k in range(70):
        own = []
        for _ in range(rng.randint(0, 6)):
            line, at = rng.choice(bases), 0
            for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
                at = rng.randrange(len(line) + 1)
                line = rng.choice([line[:at] + "x" + line[at:], line[:at] + line[at + 1 :], line[:at] + "y" + line[at + 1 :]])
            own.append(line)
        docs.append((k, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n \n"), (None, bases[5]), (103, docs[3][1])]
    got = [tuple(r) for r in line_dedup.dedup_lines(frame(spark, docs).withColumn("gone", F.lit(1))).collect()]
    assert ordered(got) == ordered(kept_lines(docs))


def test_repeated_rows_keep_the_same_lines(spark):
    docs = [(1, "one line of words\nand a second one"), (1, "one line of words\nand a second one"), (2, "one line of words\nmore"), (3, "one line of words")]
    out = line_dedup.drop_repeated_lines(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, docs[0][1]), (1, docs[0][1]), (2, "more")]
    assert line_dedup.dedup_lines(frame(spark, docs).where("false")).count() == 0


# --- quality -------------------------------------------------------------------------


def surface(text):
    text = text or ""
    w = words(text)
    seen = collections.defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    repeated = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
    lines = [line for line in text.split("\n") if words(line)]
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_surface_counts_and_fertility(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "of", "é#", "a|b", "cat\ncat", "日本"], k=rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \n", "the quick brown fox jumps over the lazy dog again\n" * 9, " ".join(chr(0x1F900 + k) for k in range(40)), "only words that differ " * 1 + " ".join(f"number{k}" for k in range(30))]
    got = {r["doc_id"]: r for r in quality.measures(frame(spark, list(enumerate(texts)))).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == surface(t)
        ids = lib.encode(t or "")
        n = max(1, len(ids))
        entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())
        share = sum(lib.is_byte(i) and not 9 <= int(lib.id_to_piece(i)[3:5], 16) <= 13 for i in ids) / n
        assert (r["n_tokens"], r["chars_per_token"], r["byte_share"]) == (len(ids), pytest.approx(r["word_chars"] / n), pytest.approx(share)) and r["entropy"] == pytest.approx(entropy, abs=1e-9)
        assert not (r["kept"] and r["base_failed"])
    assert not got[len(texts) - 2]["kept"] and not got[len(texts) - 2]["base_failed"]  # emoji noise in an English text
    assert got[len(texts) - 1]["kept"]
    kept = quality.keep_good(frame(spark, list(enumerate(texts))))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]} and kept.columns == frame(spark, []).columns
    assert quality.measures(frame(spark, [])).count() == 0


def test_the_band_follows_the_script_of_the_text(spark):
    chinese = "".join(chr(0x4E00 + 7 * k) + (" " if k % 3 == 2 else "") for k in range(120))
    latin = " ".join(f"{w} and {w}s again" for w in ("word", "stone", "river", "garden", "window", "paper", "winter", "silver"))
    rows = [(1, chinese, "en"), (2, chinese, "zh"), (3, latin, "zh"), (4, latin, "en"), (5, latin, None)]
    docs = spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in rows], DOC)
    assert {r["doc_id"]: r["kept"] for r in quality.measures(docs).collect()} == dict.fromkeys(range(1, 6), True)
    narrow = {"en": quality.Band((50.0, 60.0)), "zh": quality.Band((50.0, 60.0))}
    kept = {r["doc_id"]: r["kept"] for r in quality.measures(docs, narrow).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: False, 5: True}  # text in another script is judged as text of no language


# --- personal data ------------------------------------------------------------------------


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    found = [(m.start(), m.end(), kind) for kind, (pattern, ok) in BASE.items() for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize("piece", ["user.", "http://!", "http://a", "user=", "user x1.", "a@", "+1 ", "1.", "1-", "iban: ._"])
def test_very_long_texts_take_linear_time(piece):
    start = time.perf_counter()
    pii.find_spans(piece * 200_000)
    assert time.perf_counter() - start < 8  # quadratic work takes hours


def test_personal_data_of_no_documents(spark):
    assert pii.find_personal_data(frame(spark, [])).count() == 0


@pytest.mark.parametrize("alphabet", ["0123456789. -+()@ab", "0123456789", "01. ", "a@.-b ", "+1 2()", "4111 -1.é\n"])
def test_base_spans_are_those_of_the_expressions(alphabet):
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert [s for s in pii.find_spans(text) if s[2] in BASE] == base_spans(text), text


def test_address_with_a_long_run_of_zeros():
    text = "0" * 5000 + ".1.1.1"
    assert [s for s in pii.find_spans(text) if s[2] == "ip"] == [(0, len(text), "ip")]
    assert not [s for s in pii.find_spans("0" * 5000 + "256.1.1.1") if s[2] == "ip"]


def test_personal_data_rows(spark):
    text = "é mail a.b+c@ex-1.example.org, 10.0.0.1, 4111 1111 1111 1111 +49 (30) 1234-5678; see https://ex.org/a?b=1). IBAN: DE89370400440532013000."
    rows = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, [(1, text), (2, None), (3, ""), (None, "x@y.z"), (4, "x@y.z " * 20000)])).collect()}
    got = {s.split(":")[0]: text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in rows[1]["spans"].split(",")}
    assert got == {"email": "a.b+c@ex-1.example.org", "ip": "10.0.0.1", "card": "4111 1111 1111 1111", "phone": "+49 (30) 1234-5678", "url": "https://ex.org/a?b=1", "account": "DE89370400440532013000"}
    base = ",".join(f"{k}:{a}:{b}" for a, b, k in base_spans(text))
    assert rows[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and rows[2]["spans"] == "" and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[None]["n_email"] == 1 and rows[4]["n_email"] == 20000 and rows[3]["n_ip"] == 0


# --- SentencePiece ---------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdefghij tion  \n\t.,0"), st.characters(blacklist_categories=("Cs",)))), max_size=5))
def test_ids_and_texts_equal_the_library(texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    fst = pieces.load()
    ids, offsets = fst.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [lib.encode(t) for t in texts]
    assert fst.decode(ids, offsets) == [t.replace("▁", " ") for t in texts]


def test_encode_rows_and_back(spark):
    docs = [(1, "two  words\nand é"), (2, None), (3, ""), (None, "x"), (1, "two  words\nand é"), (4, "long " * 50000), (5, "z" * 5000)]
    out = pieces.encode(frame(spark, docs).withColumn("ids", F.lit(0)))
    rows = out.collect()
    assert ordered([(r["doc_id"], r["decoded"]) for r in rows]) == ordered([(d, t or "") for d, t in docs])
    back = pieces.decode(out.withColumn("ids", F.when(F.col("n_tokens") > 0, F.col("ids"))))
    assert ordered([tuple(r) for r in back.collect()]) == ordered([(d, t or "") for d, t in docs])
    assert pieces.encode(frame(spark, [])).count() == 0


# --- token files -------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 99_999), max_size=200), st.integers(1, 60))
def test_blocks_round_trip(ids, times):
    ids = np.array(ids * times, np.int32)
    raw = token_codec.pack([None, 5], np.array([0, len(ids)]), ids)
    ((docs, counts, back),) = token_codec.segments(io.BytesIO(raw))
    assert docs == [None, 5] and counts.tolist() == [0, len(ids)] and back.tolist() == ids.tolist()


def test_repeats_are_cheap_and_damage_is_found():
    ids = np.tile(np.arange(100, 140, dtype=np.int32), 600)
    raw = token_codec.pack([1], np.array([len(ids)]), ids)
    assert len(raw) < len(ids) / 2
    bad = bytearray(raw)
    bad[len(bad) // 2] ^= 255
    with pytest.raises(ValueError, match="checksum"):
        list(token_codec.segments(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError, match="ends inside"):
        list(token_codec.segments(io.BytesIO(raw[:-5])))


def test_token_rows(spark, monkeypatch):
    monkeypatch.setattr(token_codec, "ROWS_PER_FILE", 8)
    rng = random.Random(6)
    parts = ["the", "cat's", "ÉTÉ", "<|endoftext|>", "1234", "a b", "é", "..", '"', "\n"]
    docs = [(k * 3 % 50, " ".join(rng.choices(parts, k=rng.randint(0, 40)))) for k in range(50)] + [(60, None), (61, ""), (None, "x y"), (7, "same id"), (7, "same id")]
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = [tuple(r) for r in token_codec.round_trip(frame(spark, docs).withColumn("start", F.lit(1)), with_ids=True).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_codec.round_trip(frame(spark, [])).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ -= full or open_
    return target


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mix_meets_its_targets(spark, block):
    rng = random.Random(12)
    docs = [(k, "w " * rng.choice([0, 1, 3, 20, 200]), "en", rng.choice(["a", "a", "a", "b", "c", "é", None, "tiny" if k % 40 == 0 else "a"]), 0) for k in range(160)]
    docs += [docs[3], docs[3], (500, None, "en", "a", 0), (None, "x y z", "en", "b", 0), (501, "", "en", "empty", 0)]
    df = spark.createDataFrame(docs, DOC).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    rows = mixing.mix(df, block).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len(words(t))
    target, size_of = water_fill(dict(sizes)), collections.Counter()
    assert ordered([(r["doc_id"], r["size"]) for r in rows]) == ordered([(d, len(words(t))) for d, t, _, _, _ in docs])
    by_pair = collections.defaultdict(int)
    for r in rows:
        by_pair[(r["source_size"], round(r["target"], 6))] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_slot"] is None) == (r["last_slot"] is None) == (r["taken"] == 0)
        assert r["taken"] == 0 or 0 <= r["first_slot"] <= r["last_slot"]
    want = collections.defaultdict(int)
    for s, n in sizes.items():
        want[(n, round(target[s], 6))] += math.floor(target[s] + 1e-9)
    assert dict(by_pair) == dict(want)
    assert ordered([tuple(r) for r in rows]) == ordered([tuple(r) for r in mixing.mix(df.repartition(3), block).collect()])
    copies = collections.Counter()
    for r in mixing.mixed_documents(df, block).collect():
        copies[r["doc_id"]] += len(words(r["text"]))
        assert r["target"] == 1
    for r in rows:
        size_of[r["doc_id"]] += r["taken"]
    assert {d: n for d, n in size_of.items() if n} == dict(copies)


def test_the_schedule_spreads_each_source_evenly(spark):
    per = spark.createDataFrame([("a", 600_000, 600_000.0), ("b", 300_000, 300_000.0), ("c", 100_000, 100_000.0)], "source string, source_size long, target double")
    rows = mixing.schedule(per, 1000).orderBy("slot").collect()
    assert len(rows) == 1000
    for upto in (50, 200, 500, 900):
        seen = collections.Counter(r["source"] for r in rows[:upto])
        assert all(abs(seen[s] - upto * share) <= 4 for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)))
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [])).count() == 0


def test_documents_carry_the_slots_that_take_them(spark):
    source = ["a"] * 150 + ["b"] * 100 + ["c"] * 50
    df = spark.createDataFrame([(k, "w", "en", s, 0) for k, s in enumerate(source)], DOC)
    rows = mixing.mix(df, 1).collect()
    target = {source[r["doc_id"]]: r["target"] for r in rows}
    assert target == {s: pytest.approx(t) for s, t in (("a", 262.5), ("b", 87.5), ("c", 100.0))}
    # With one word a document and a block, a document has a slot for each word that is taken of it.
    slots = sorted((k, source[r["doc_id"]]) for r in rows if r["taken"] for k in {r["first_slot"], r["last_slot"]})
    assert len(slots) == len({k for k, _ in slots}) == sum(r["taken"] for r in rows) == 449
    for upto in (45, 150, 300, 420):
        seen = collections.Counter(s for _, s in slots[:upto])
        assert all(abs(seen[s] - upto * t / 450) <= 4 for s, t in target.items())


def test_shares_of_the_orders_follow_what_was_right():
    mixer = token_codec._Mixer(2)
    row = np.tile(mixer.base + (3 << 3 | 3 << 1), (64, 1))
    mixer.learn(row, np.tile(np.array([0, 3]), (64, 1)), np.full(64, token_codec.CLASSES + 5))
    upto = mixer.upto.reshape(2, mixer.ROWS, 5).astype(int)
    assert (np.diff(upto, axis=2) >= 1).all() and (upto[:, :, 4] == token_codec.TOTAL).all()
    share = np.diff(upto[:, 3 << 3 | 3 << 1], axis=1) / token_codec.TOTAL
    assert share[0, 0] > 0.9 and share[1, 3] > 0.9


def test_frequent_ids_are_cheaper_than_rare_ones():
    rng = np.random.default_rng(3)
    skewed = np.minimum(rng.zipf(1.6, 40_000), 30_000).astype(np.int32)
    even = rng.integers(1, 30_000, 40_000).astype(np.int32)
    count = np.bincount(skewed) / len(skewed)
    floor = -np.sum(count[count > 0] * np.log2(count[count > 0])) / 8
    size = [len(token_codec.pack([1], np.array([len(x)]), x)) / len(x) for x in (skewed, even)]
    assert size[0] < 1.35 * floor + 0.1 and size[1] < 2.1  # 14.9 bits of an even id are 1.86 bytes
