"""Line dedup across documents by a deletion-neighbourhood join. DataFrame functions only.

Lines are the parts between line breaks; lines without a word take no part. A line goes if an earlier one
(by doc_id, then text, then place) is equal, or, for lines of at least ``MIN_CHARS`` characters, within one
edit (a character replaced, inserted or deleted).

Two lines within one edit have a deletion variant in common: the line itself, or the line without one
character. Variants of every line would be as many as the characters of the corpus, so a filter that loses
no pair comes first: cut at the middle, such lines agree in a half, and in the length up to one; cut into segments, they agree
around one of them. Only lines that share a half, and of these segments with the same surroundings, are kept;
theirs are the variants that are emitted, as hashed keys of (length class, segment, what stands before, after
and in the segment), joined, and verified by edit distance.
Equal lines are one row from the first aggregate on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MIN_CHARS = 20
SEGMENT, SEGMENTS = 64, 64


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line, h1, h2) of every line with a word."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = own.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))


def _half(n: Column) -> Column:
    return F.floor((n - 1) / 2).cast("int")


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and the last half, for pairs of this length and for those with a line longer by one."""

    def both(length: Column) -> list[Column]:
        size = _half(length)
        return [F.xxhash64(length, F.lit(0), F.left(line, size)), F.xxhash64(length, F.lit(1), F.right(line, size))]

    return F.array(*both(n), *both(n + 1))


def _variants(lines: DataFrame) -> DataFrame:
    """(variant, role, h1, h2) for (h1, h2, line): the deletion variants, each hashed with its place in the line.

    Lines of equal length share the key of a replaced character's place and the rest of the line (role 0). A
    line without one of its characters (role 1) shares the key of the rest with the shorter line that is the
    rest (role 2). So all of role 0 in a key are within one edit of each other, as are role 1 and role 2.

    A class is the length of the longer line. It cuts its lines into segments, counted from the left before
    the segment and from the right after it, and hashes what is around a segment once.
    """
    size = F.char_length("line")
    classed = lines.withColumn("shorter", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("n", size + F.col("shorter"))
    classed = classed.withColumn("width", F.greatest(F.lit(SEGMENT), F.ceil(F.col("n") / SEGMENTS).cast("int")))
    cut = classed.withColumn("at", F.explode(F.expr("sequence(0, n - 1, width)")))
    after = F.greatest(F.lit(0), F.col("n") - F.col("at") - F.col("width"))
    cut = cut.withColumn("around", F.xxhash64("n", "at", F.left("line", F.col("at")), F.right("line", after)))
    cut = cut.withColumn("part", F.substring("line", F.col("at") + 1, size - F.col("at") - after))
    # A line can have a partner within a segment only if another line is the same around it.
    cut = cut_lineage(cut.select("h1", "h2", "shorter", "around", "part"))
    twice = cut.groupBy("around").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("around")
    cut = cut.join(twice, "around", "leftsemi")
    whole = cut.where("shorter = 1").select(F.xxhash64("around", F.lit(-1), "part").alias("variant"), F.lit(2).alias("role"), "h1", "h2")
    less = cut.where("shorter = 0").withColumn("i", F.explode(F.expr("sequence(1, char_length(part))")))
    less = less.withColumn("rest", F.concat(F.left("part", F.col("i") - 1), F.expr("substring(part, i + 1)")))
    for_place, for_rest = F.struct(F.xxhash64("around", "i", "rest").alias("variant"), F.lit(0).alias("role")), F.struct(F.xxhash64("around", F.lit(-1), "rest").alias("variant"), F.lit(1).alias("role"))
    return less.select(F.explode(F.array(for_place, for_rest)).alias("v"), "h1", "h2").select("v.*", "h1", "h2").union(whole).distinct()


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, gone): every line with a word, and of these (doc_id, text_key, line_no, near) each that goes; near: not an equal of an earlier one."""
    lines = _lines(docs)
    place = F.struct("doc_id", "text_key", "line_no")
    n = F.char_length("line")
    keys = F.when(n >= MIN_CHARS - 1, _half_keys(F.col("line"), n))
    slim = lines.select("doc_id", "text_key", "line_no", "h1", "h2", keys.alias("keys"))
    slim = cut_lineage(slim)
    first = slim.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("keys").alias("keys"))
    first = cut_lineage(first)
    halves = first.select(F.explode("keys").alias("key"), "h1")
    shared = halves.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("key")
    hopeful = cut_lineage(halves.join(shared, "key", "leftsemi").select("h1").distinct())
    texts = lines.where(n >= MIN_CHARS - 1).select("h1", "h2", "line").join(hopeful, "h1", "leftsemi")
    texts = cut_lineage(texts.groupBy("h1", "h2").agg(F.first("line").alias("line")).join(first.select("h1", "h2", "first"), ["h1", "h2"]))
    variants = cut_lineage(_variants(texts.select("h1", "h2", "line")))
    named = variants.join(texts.select("h1", "h2", F.struct("first", "h1", "h2").alias("e")), ["h1", "h2"])
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("e"))).alias(f"e{role}")
    least = named.groupBy("variant").agg(of(0), of(1), of(2), F.count("*").alias("m")).where("m > 1").drop("m")
    met = F.when(F.col("role") == 0, F.col("e0")).when(F.col("role") == 1, F.col("e2")).otherwise(F.col("e1"))
    pairs = named.join(least, "variant").withColumn("met", met).where(F.col("met.first") < F.col("e.first"))
    pairs = pairs.select("h1", "h2", F.col("met.h1").alias("e1"), F.col("met.h2").alias("e2")).distinct()
    a, b = texts.select("h1", "h2", F.col("line").alias("a")), texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("b"))
    both = pairs.join(a, ["h1", "h2"]).join(b, ["e1", "e2"]).where(F.greatest(F.char_length("a"), F.char_length("b")) >= MIN_CHARS)
    near = both.where((F.levenshtein("a", "b", 1) >= 0) & (F.levenshtein("a", "b", 1) <= 1)).select("h1", "h2").distinct().withColumn("near", F.lit(True))
    marks = first.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    gone = slim.select("doc_id", "text_key", "line_no", "h1", "h2").join(marks, ["h1", "h2"]).where(F.col("near") | (place > F.col("first")))
    return lines, gone.select("doc_id", "text_key", "line_no", F.coalesce("near", F.lit(False)).alias("near"))


def _marked(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, gone): every row of ``docs`` with the numbers of the lines that go (null for none)."""
    _, gone = repeated_lines(docs)
    per = gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone"), F.count_if("near").alias("n_near"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    d, g = own.alias("d"), per.alias("g")
    return d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key")), "left").select("row", "d.doc_id", "text", "gone", "n_near")


def _kept_text() -> Column:
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    rest = F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n")
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_equal, n_near, kept_text) for every row of ``docs`` (doc_id, text).

    n_lines: lines with a word; n_equal and n_near: those that go. Lines without a word stay. A null text has
    no lines and stays null. Null doc_ids come first in the order; rows that agree in doc_id and text are one
    document and keep the same lines. Of lines within one edit that are both the earliest of nothing else,
    the later goes. Other columns are ignored; an empty table gives no rows.
    """
    n_lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")
    n_gone, n_near = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"), F.coalesce("n_near", F.lit(0)).cast("long")
    return _marked(docs).select("doc_id", n_lines.alias("n_lines"), (n_gone - n_near).alias("n_equal"), n_near.alias("n_near"), _kept_text().alias("kept_text"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts, all columns as they are.

    Rows whose every line with a word goes are left out; rows that had none stay.
    """
    out = _marked(docs).select("row", "gone", _kept_text().alias("kept_text"))
    out = out.where(F.col("gone").isNull() | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("kept_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
