"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

Targets: sources share ``TOTAL`` times all words by weight, none above ``MOST`` times its own words, the
excess going to the others by weight until none is above.

Schedule: slot i has the golden-ratio point frac(i / phi); the cumulative shares of the sources cut the unit
interval, so the point names a source, and the slot takes that source's next block. Blocks are equal runs of
``BLOCK`` words of the source's documents in shuffled order; after the last block the source starts over.
A source stops at its target, in the middle of a block if need be, and slots that low-discrepancy points
leave open at the end of the schedule follow in turn. So a source takes its target rounded down, and a
document at most twice its words.

Positions within a source are prefix sums in two levels (hash ranges of a source, then rows of a range), so
that a source with a third of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import WORD_PATTERN

WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2
BLOCK = 1024
RANGE_ROWS = 20_000
SLOTS = 65_536
CELLS = 65_536
#: Golden-ratio points as integers: i * STEP mod 2**31, in steps of 2**-31.
STEP, UNIT = 1_327_217_885, 1 << 31


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, size); one row per source, so its windows hold as many rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).cast("long"))
    # With the sources in the order in which they reach their limit, let level j share what is left when all
    # before j stand at their limit. It rises until the first source that stays below its limit, then falls.
    cap = F.col("source_size") * MOST
    by_need = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(TOTAL) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / weight_left)
    target = F.least(F.max("level").over(whole) * F.col("weight"), cap.cast("double"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _running(rows: DataFrame, group: list[str], part: str, order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the group's rows before, by (part, order). Parts are summed first."""
    sums = rows.groupBy(*group, part).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(part).alias("__part"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    match = [rows[g].eqNullSafe(offsets[f"__{g}"]) for g in group] + [rows[part] == offsets["__part"]]
    own = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, match).withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(own), F.lit(0)))
    return out.drop(*[f"__{g}" for g in group], "__part", "__before")


def _positions(sizes: DataFrame, *more: str) -> DataFrame:
    """Adds ``at``: the words before the document in its source's shuffled order."""
    parts = max(1, -(-sizes.count() // RANGE_ROWS))
    rows = sizes.withColumn("h", F.xxhash64("doc_id", F.lit(17))).withColumn("part", F.floor((F.col("h") / float(1 << 64) + 0.5) * parts).cast("long"))
    return _running(rows, ["source"], "part", ["h", "doc_id", "size", *more], "size", "at")


def schedule(per_source: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, source_size, block_no, lo, hi): which words [lo, hi) of which block of a source the slot takes.

    ``per_source``: (source, source_size, target). The slot numbers give the order of the mix.
    """
    spark = per_source.sparkSession
    per_epoch = F.ceil(F.col("source_size") / block).cast("long")
    words = F.floor("target").cast("long")
    rest = words % F.col("source_size")
    need = F.floor(words / F.col("source_size")).cast("long") * per_epoch + F.ceil(rest / block).cast("long")
    per = per_source.where("source_size > 0").select("source", "source_size", words.alias("words"), per_epoch.alias("per_epoch"), need.alias("need")).where("need > 0")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("need").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    point = lambda c: F.round(c / all_ * UNIT).cast("long")
    per = cut_lineage(per.withColumn("hi_point", point(upto)).withColumn("lo_point", point(upto - F.col("need"))))
    total = per.agg(F.sum("need")).first()[0] or 0
    width = UNIT // CELLS
    cells = per.where("hi_point > lo_point").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo_point") / width), F.floor((F.col("hi_point") - 1) / width))))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / SLOTS).alias("part"), (((F.col("id") % UNIT) * STEP) % UNIT).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / width)).join(cells.drop("words", "per_epoch", "need", "source_size"), "cell")
    slots = slots.where("point >= lo_point AND point < hi_point").select("slot", "part", "source", F.lit(1).cast("long").alias("one"))
    ranked = _running(slots, ["source"], "part", ["slot"], "one", "k")
    had = ranked.groupBy("source").agg(F.count("*").alias("had"))
    short = per.alias("p").join(had.alias("h"), F.col("p.source").eqNullSafe(F.col("h.source")), "left").select("p.source", "need", F.coalesce("had", F.lit(0)).alias("had")).where("had < need")
    late = short.withColumn("k", F.explode(F.sequence(F.col("had"), F.col("need") - 1))).select((F.col("k") + total).alias("slot"), "source", "k")
    taken = ranked.select("slot", "source", "k").union(late).alias("t").join(per.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source"))).where("k < need")
    epoch, block_no = F.floor(F.col("k") / F.col("per_epoch")), F.col("k") % F.col("per_epoch")
    left = F.col("words") - epoch * F.col("source_size")
    hi = F.least((block_no + 1) * block, F.col("source_size"), left)
    return taken.select("slot", "p.source", "source_size", block_no.alias("block_no"), epoch.alias("epoch"), (block_no * block).alias("lo"), hi.alias("hi"))


def _takes(placed: DataFrame, per: DataFrame, block: int) -> DataFrame:
    """The columns of ``placed`` for each document and slot that meet, with ``epoch``, ``slot`` and ``words``; documents that no slot takes have 0."""
    spread = placed.where("size > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    d, s = spread.alias("d"), schedule(per, block).alias("s")
    both = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.block_no") == F.col("s.block_no")), "left")
    words = F.greatest(F.lit(0), F.least(F.col("hi"), F.col("at") + F.col("size")) - F.greatest(F.col("lo"), F.col("at")))
    return both.select("d.*", "epoch", "slot", F.when(F.col("hi").isNull(), 0).otherwise(words).alias("words"))  # least and greatest skip nulls


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, last_slot) for every row of ``docs`` (doc_id, text, source).

    The slots are those of the schedule that take words of the document, the first and the last of them: reading
    the mix in their order keeps every stretch of it near the target shares. Null where nothing is taken. A null or blank text has size 0 and takes nothing; a null source is a source of its own, the last; a
    source without words has target 0. Repeated rows take their own places. Other columns are ignored; an
    empty table gives no rows. The order within a source hangs on doc_id and size alone, so reruns agree.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    sizes = cut_lineage(own)
    per = cut_lineage(targets(sizes))
    placed = cut_lineage(_positions(sizes))
    used = F.when(F.col("words") > 0, F.col("slot"))
    taken = _takes(placed, per, block).groupBy("source", "at").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum("words").alias("taken"), F.min(used).alias("first_slot"), F.max(used).alias("last_slot")
    )
    none = F.lit(None).cast("long")
    rows = taken.select("doc_id", "source", "size", "taken", "first_slot", "last_slot").union(sizes.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long"), none, none))
    r, p = rows.alias("r"), per.alias("p")
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents of the mix, columns as they are: each once per pass over its source that takes words of it.

    The document at which a source stops is cut to the words taken (joined by one space), every other copy is
    whole. Documents without words do not appear. Needs doc_id, text and source.
    """
    names = docs.columns
    key = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), key.alias("key"))
    counted = sizes.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("times"))
    sizes = cut_lineage(counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times"))
    per = cut_lineage(targets(sizes))
    placed = cut_lineage(_positions(sizes, "key", "copy"))
    takes = _takes(placed, per, block).where("words > 0").groupBy("key", "copy", "size", "epoch").agg(F.sum("words").alias("words"))
    whole = F.when(F.col("words") < F.col("size"), F.col("words"))
    plan = takes.groupBy("key").agg(F.collect_list(F.struct("copy", whole.alias("upto"))).alias("takes"))
    rows = docs.select(F.struct(*[docs[n] for n in names]).alias("row"), key.alias("key"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    out = rows.join(plan, "key").withColumn("take", F.explode("takes")).where("take.copy = copy")
    words = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.col("take.upto").cast("int")), " ")
    text = F.when(F.col("take.upto").isNull(), F.col("row.text")).otherwise(words)
    return out.select(*[text.alias(n) if n == "text" else F.col("row")[n].alias(n) for n in names])
