"""Distribution and potential tables as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.curves import with_force
from ..session import cut_lineage, spread
from .tables import _lines


def classify_file(name):
    """bond, angle, dihedral or pair from a file name; g(r) files count as pair."""
    n = F.lower(name)
    return F.when(n.rlike("dihedral"), "dihedral").when(n.rlike("angle"), "angle").when(n.rlike("bond"), "bond").when(n.rlike("rdf|pair|nonbond|nb"), "pair")


def _name(path="file"):
    """File name; inside a folder ``name=...`` the name of that folder."""
    folder = F.regexp_extract(path, r"/name=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))


def type_ids(name):
    """Type numbers of a file name, joined by a dash."""
    return F.array_join(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), "-")


def discover_distributions(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, types) of the distribution files below a folder, read from file listings only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    named = files.withColumn("name", _name()).where(F.col("name").rlike(r"(\.dist\.tgt|_dist\.txt)$"))
    return named.dropDuplicates(["name"]).select("file", "name", classify_file(F.col("name")).alias("kind"), type_ids(F.col("name")).alias("types"))


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, types, temperature, i, x, p, step): two or three columns, bad and negative values as 0.

    The kind comes from the file name, then from the header.
    """
    # The files are many and small: they are opened once.
    lines = cut_lineage(_lines(spark, path).withColumn("_t", F.trim("line")).where("_t <> ''").select("file", "_t"))
    head = lines.where("_t LIKE '#%'").groupBy("file").agg(
        F.max(classify_file(F.col("_t"))).alias("_hk"), F.max(F.regexp_extract("_t", r"(?i)temperature\s*[=:]\s*([\d.]+)", 1)).alias("_temp"))
    rows = lines.where("NOT _t LIKE '#%'").withColumn("_v", F.split("_t", r"\s+"))
    p = F.get("_v", F.lit(1)).try_cast("double")
    clean = F.when(p.isNull() | F.isnan(p), 0.0).otherwise(F.greatest(p, F.lit(0.0)))
    first = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.get("_v", F.lit(0)).cast("double"))).alias("_xs"))
    out = rows.join(first, "file").join(head, "file", "left").withColumn("name", _name())
    x = F.get("_v", F.lit(0)).cast("double")
    return out.select(
        "file", "name", F.coalesce(classify_file(F.col("name")), "_hk").alias("kind"), type_ids(F.col("name")).alias("types"),
        F.expr("try_cast(_temp AS double)").alias("temperature"), (F.array_position("_xs", x) - 1).alias("i"), x.alias("x"), clean.alias("p"),
        (F.get("_xs", F.lit(1)) - F.get("_xs", F.lit(0))).alias("step"),
    )


def read_potential_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, types, n_header, n_rows, count_ok, angle_unit, i, x, u, f) from ``N`` headed tables, sorted by x."""
    lines = cut_lineage(_lines(spark, path).select("file", F.trim("line").alias("_t"))).withColumn("name", _name())
    head = lines.where("_t rlike '^N +[0-9]+'").groupBy("file").agg(
        F.max(F.regexp_extract("_t", r"^N\s+(\d+)", 1).cast("bigint")).alias("n_header"), F.max(F.regexp_extract("_t", r"(DEGREES|RADIANS)", 1)).alias("_unit"))
    rows = lines.where(r"_t rlike '^[0-9]+\\s+[-+0-9.eE]+\\s+[-+0-9.eE]+\\s+[-+0-9.eE]+$'").withColumn("_v", F.split("_t", r"\s+"))
    cols = [F.get("_v", F.lit(k)).cast("double").alias(c) for k, c in ((1, "x"), (2, "u"), (3, "f"))]
    cells = rows.select("file", "name", *cols)
    stats = cells.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.max("x").alias("_mx"), F.array_sort(F.collect_list("x")).alias("_xs"))
    unit = F.when(F.col("_unit") == "DEGREES", "deg").when(F.col("_unit") == "RADIANS", "rad").when(F.abs(F.col("_mx") - 180.0) < 5, "deg").when(F.abs(F.col("_mx") - 3.14159265) < 0.1, "rad")
    kind = classify_file(F.col("name"))
    return cells.join(stats, "file").join(head, "file", "left").select(
        "file", "name", kind.alias("kind"), type_ids(F.col("name")).alias("types"), "n_header", "n_rows", (F.col("n_header") == F.col("n_rows")).alias("count_ok"),
        F.when(kind.isin("angle", "dihedral"), unit).alias("angle_unit"), (F.array_position("_xs", F.col("x")) - 1).alias("i"), "x", "u", "f")


def _write_per_file(lines: DataFrame, path: str) -> None:
    """One folder per file name; a table of some hundred lines stays together and in order."""
    spread(lines, "name").sortWithinPartitions("name", "part", "i").select("name", "line").write.partitionBy("name").mode("append").text(path)


def write_distributions(curves: DataFrame, path: str, finished: DataFrame | None = None) -> None:
    """``x P i`` rows per curve; names listed in ``finished`` are left alone."""
    if finished is not None:
        curves = curves.join(finished.select("name").distinct(), "name", "left_anti")
    rows = curves.select("name", F.lit(1).alias("part"), "i", F.format_string("%.6f %.10e i", "x", "p").alias("line"))
    _write_per_file(rows, path)


def potential_lines(potentials: DataFrame, contributor: str = "beadloom") -> DataFrame:
    """``idx x U F`` sections with the force recomputed; unsampled points dropped.

    Columns: name, kind, i, x, u.
    """
    known = potentials.where("abs(u) < 1e300")  # not so for null and NaN either
    forced = with_force(known, "u", ("name", "kind")).drop("d2f")
    sizes = forced.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    spec = F.when(F.col("kind") == "pair", F.format_string("N %d R %.6f %.6f", "_n", "_lo", "_hi")).when(
        F.col("kind") == "dihedral", F.format_string("N %d DEGREES", "_n")).otherwise(F.format_string("N %d", "_n"))
    head = sizes.select("name", F.posexplode(F.array(F.lit(f"# contributor: {contributor}"), F.col("name"), spec, F.lit(""))).alias("part", "line")).withColumn("i", F.lit(0).cast("bigint"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("name").orderBy("x"))
    body = forced.withColumn("_no", number).select("name", F.lit(9).alias("part"), F.format_string("%d %.10e %.10e %.10e", "_no", "x", "u", "f").alias("line"), F.col("_no").cast("bigint").alias("i"))
    return head.select("name", "part", "line", "i").unionByName(body)


def write_potentials(potentials: DataFrame, path: str) -> None:
    _write_per_file(potential_lines(potentials), path)
