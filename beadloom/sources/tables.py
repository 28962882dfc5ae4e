"""Tabular sources and sinks: sectioned data files, CSV and whitespace tables, nested Parquet."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import with_pair_type
from ..session import cut_lineage, spread
from . import blocks


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Rows of all runs with a ``run`` column."""
    parts = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_run_path(df: DataFrame, path_col: str = "file") -> DataFrame:
    """traj and chunk numbers from paths like .../chunk2/md7/... or .../chunk=2/md=7/...; order by (traj, chunk, timestep)."""
    return df.withColumn("chunk", F.regexp_extract(path_col, r"chunk=?(\d+)", 1).cast("bigint")).withColumn(
        "traj", F.regexp_extract(path_col, r"md=?(\d+)", 1).cast("bigint"))


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line_no, line) of whole small files, line numbers from 0."""
    reader = spark.read.option("wholetext", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


# Section names of a topology data file.
SECTIONS = ("Masses", "Atoms", "Velocities", "Bonds", "Angles", "Dihedrals", "Impropers")


def _fill_marks(batches):
    """(path_id, block, line, section): the last mark at or before each line in its block, null before the first; marks themselves go."""
    for key, parts in blocks.by_block(batches):
        now = None
        for part in parts:
            marks = part.column("mark")
            at = np.flatnonzero(pc.is_valid(marks).to_numpy(zero_copy_only=False))
            names = [now, *marks.take(pa.array(at)).to_pylist()]
            owner = np.zeros(len(marks), np.int64)
            owner[at] = 1
            owner = np.cumsum(owner)
            now = names[-1]
            keep = np.ones(len(marks), bool)
            keep[at] = False
            rows = np.flatnonzero(keep)
            yield pa.RecordBatch.from_pydict(
                {
                    "path_id": part.column("path_id").take(pa.array(rows)), "block": part.column("block").take(pa.array(rows)),
                    "line": part.column("line").take(pa.array(rows)), "section": pa.array(names, pa.string()).take(pa.array(owner[rows])),
                }
            )


def section_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, values, comment): rows under their section header, matched by prefix.

    A file is read in blocks by many tasks; rows before the first header of a block belong to the last section
    of the blocks before it.
    """
    name = F.regexp_extract(F.trim("line"), r"^([A-Z][A-Za-z]+)", 1)
    mark = F.when(name.isin(*SECTIONS), name).when(F.col("line").rlike("Coeffs"), F.lit("Coeffs")).alias("mark")
    order = F.monotonically_increasing_id()
    heads = blocks.block_lines(spark, path, mark, paths=True).withColumn("_o", order).groupBy("path_id", "block", "path").agg(
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("_o"))).alias("last"))
    known = heads.withColumn("stream", blocks.stream_name()).withColumn("carry", blocks.before("last"))
    known = cut_lineage(known.select("path_id", "block", F.col("stream").alias("file"), "carry"))
    lines = blocks.block_lines(spark, path, mark).mapInArrow(_fill_marks, "path_id long, block long, line string, section string").where("trim(line) <> ''")
    rows = blocks.with_block(lines, known)
    body = F.trim(F.regexp_replace("line", "#.*$", ""))
    return rows.select(
        "file", F.coalesce("section", "carry", F.lit("header")).alias("section"), F.split(body, r"\s+").alias("values"), F.trim(F.regexp_extract("line", "#(.*)$", 1)).alias("comment"))


def _cells(rows: DataFrame, section: str, columns: list[tuple[str, str, int]]) -> DataFrame:
    return rows.where(F.col("section") == section).select("file", *[F.get("values", F.lit(k)).cast(kind).alias(name) for name, kind, k in columns])


def read_data_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Atoms (six fields), bonds without their id, and box edges of every file under ``path``."""
    # Parsed once for the three tables.
    rows = cut_lineage(section_rows(spark, path).where("section IN ('Atoms', 'Bonds', 'header')").select("file", "section", "values"))
    atoms = _cells(rows, "Atoms", [("id", "bigint", 0), ("mol_id", "bigint", 1), ("type", "bigint", 2), ("x", "double", 3), ("y", "double", 4), ("z", "double", 5)])
    bonds = _cells(rows, "Bonds", [("bond_type", "bigint", 1), ("a1", "bigint", 2), ("a2", "bigint", 3)])
    head = rows.where("section = 'header' AND size(values) = 4 AND values[2] rlike '^[xyz]lo$'")
    box = head.select("file", F.substring(F.get("values", F.lit(2)), 1, 1).alias("axis"), F.get("values", F.lit(0)).cast("double").alias("lo"), F.get("values", F.lit(1)).cast("double").alias("hi"))
    return {"atoms": atoms, "bonds": bonds, "box": box}


def read_masses(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, mass, name): positive masses; a file without any fails the query."""
    rows = section_rows(spark, path)
    masses = _cells(rows.withColumn("values", F.array_append("values", F.col("comment"))), "Masses", [("type", "bigint", 0), ("mass", "double", 1), ("name", "string", 2)])
    masses = cut_lineage(masses).where("mass > 0")  # stored, as the filter would else go before that of the section, and cast its rows
    files = rows.select("file").distinct().join(masses, "file", "left")
    ok = F.when(F.col("type").isNotNull(), F.col("type")).otherwise(F.raise_error(F.lit("no masses found")).cast("bigint"))
    return files.withColumn("type", ok)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    schema = "bead_id BIGINT, mol_id BIGINT, bead_type BIGINT, AA_id BIGINT, mass DOUBLE"
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False).withColumnRenamed("AA_id", "atom_id")


def read_reaction_details(spark: SparkSession, path: str, rebuilt: DataFrame | None = None) -> DataFrame:
    """Reaction details from CSV with the pair type filled in; ``rebuilt`` events stand in where there is no file."""
    names = {"atom1_type_before": "t1", "atom2_type_before": "t2"}
    try:
        raw = spark.read.csv(path, header=True)
    except Exception as missing:  # AnalysisException when the path does not exist
        if rebuilt is None or "PATH_NOT_FOUND" not in str(missing):
            raise
        return with_pair_type(rebuilt)
    df = raw.withColumnsRenamed(names)
    casts = {"cycle": "bigint", "t1": "bigint", "t2": "bigint", "distance": "double", "atom1_id": "bigint", "atom2_id": "bigint", "event_id": "bigint"}
    return with_pair_type(df.select(*[F.col(c).cast(casts.get(c, "string")).alias(c) for c in df.columns]))


BLOCK_ROWS = 4096
BOND = "ARRAY<STRUCT<t: BIGINT, a1: BIGINT, a2: BIGINT>>"


def write_reaction_frames(before: DataFrame, after: DataFrame, path: str, mapping: DataFrame | None = None, keys=("frame",), folders=("frame",),
                          least_blocks: int = 256) -> None:
    """Nested landing table in a folder for each value of ``folders``: bonds, and on request the bead types before, as arrays.

    A frame is stored as many rows of about ``BLOCK_ROWS`` entries at most, their number from
    the frame's size, so no frame is gathered into one task.
    """
    parts = [before, after] + ([] if mapping is None else [mapping])
    sizes = reduce(lambda a, b: a.unionByName(b), [df.select(*keys) for df in parts]).groupBy(*keys).agg(
        F.greatest(F.lit(least_blocks), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS))).alias("_blocks"))
    # A frame is one key of the join with its size, so the sizes go to the bonds.
    sizes = cut_lineage(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= blocks.BROADCAST_BLOCKS else sizes

    def packed(df, name, place, entry):
        block = F.pmod(F.xxhash64(*place), F.col("_blocks"))
        return df.join(sizes, list(keys)).groupBy(*keys, block.alias("block")).agg(F.collect_list(entry).alias(name))

    pair, bond = [F.least("a1", "a2"), F.greatest("a1", "a2")], F.struct(F.col("bond_type").alias("t"), "a1", "a2")
    joined = packed(before, "bonds_before", pair, bond).join(packed(after, "bonds_after", pair, bond), [*keys, "block"], "full_outer")
    if mapping is not None:
        beads = packed(mapping, "mapping_before", ["bead_id"], F.struct("bead_id", "bead_type"))
        joined = joined.join(beads, [*keys, "block"], "full_outer")
    stamped = joined if "timestep" in keys else joined.withColumn("timestep", F.col("frame") * 1000)
    stamped.write.partitionBy(*folders).mode("append").parquet(path)


def read_reaction_frames(spark: SparkSession, path: str, member: str, keys=("frame",)) -> DataFrame:
    """One member of the landing table as bonds (bond_type, a1, a2) or bead types (bead_id, bead_type); the others are not read."""
    rows = spark.read.parquet(path).select(*[F.col(k).cast("bigint").alias(k) for k in keys], F.explode(member).alias("b"))
    entry = ["b.bead_id", "b.bead_type"] if member.startswith("mapping") else [F.col("b.t").alias("bond_type"), "b.a1", "b.a2"]
    return rows.select(*keys, *entry)


def read_reaction_counts(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace file with a ``# timestep name ...`` header to (file, timestep, reaction, n)."""
    lines = _lines(spark, path).where("trim(line) <> ''").withColumn("_v", F.split(F.trim(F.regexp_replace("line", "^#", "")), r"\s+"))
    heads = lines.where("line LIKE '#%'").groupBy("file").agg(F.min_by("_v", "line_no").alias("names"))
    body = lines.where("NOT line LIKE '#%'").join(heads, "file", "left")
    rows = body.select("file", "names", F.col("_v")[0].cast("bigint").alias("timestep"), F.posexplode(F.slice("_v", 2, F.size("_v") - 1)).alias("k", "n"))
    name = F.coalesce(F.get("names", F.col("k") + 1), F.concat(F.lit("reaction "), (F.col("k") + 1).cast("string")))
    return rows.select("file", "timestep", name.alias("reaction"), F.col("n").cast("bigint").alias("n"))


def read_topology(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """bonds, angles or dihedrals text: comments and an optional header skipped, both naming variants accepted."""
    n = {"bonds": 2, "angles": 3, "dihedrals": 4}[kind]
    lines = spark.read.text(path).select(F.trim("value").alias("t")).where("t <> '' AND NOT t LIKE '#%'")
    values = lines.select(F.split("t", r"[\s,]+").alias("v")).where(F.col("v")[0].rlike("^[0-9]+$"))
    return values.select(F.col("v")[0].cast("bigint").alias("type"), *[F.col("v")[k].cast("bigint").alias(f"b{k}") for k in range(1, n + 1)])


def read_reference_distances(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Samples of one column, or bins with counts expanded to samples (kept as weights on request)."""
    raw = spark.read.csv(path, header=True)
    if len(raw.columns) == 1:
        return raw.select(F.col(raw.columns[0]).cast("double").alias("distance"))
    value, count = (F.col(c).cast(k) for c, k in zip(raw.columns[:2], ("double", "bigint")))
    if weighted:
        return raw.select(value.alias("distance"), count.alias("weight"))
    return raw.select(value.alias("distance"), count.alias("_c")).where("_c > 0").select("distance", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c")))).select("distance")


def write_table_text(df: DataFrame, path: str, columns: list[str], sep: str = " ", header: bool = False) -> None:
    df.select(*columns).write.mode("append").csv(path, sep=sep, header=header)


def write_system(parts: dict[str, DataFrame], path: str) -> None:
    """Entities of a converted system as Parquet tables side by side."""
    for name, df in parts.items():
        df.write.mode("append").parquet(f"{path}/{name}")


def system_header(parts: dict[str, DataFrame], type_cols: dict[str, str]) -> DataFrame:
    """Rows and type number per entity: the highest type for particles, distinct types for bonded terms."""
    rows = []
    for name, df in parts.items():
        t = F.col(type_cols[name])
        types = F.max(t) if name == "beads" else F.count_distinct(t)
        rows.append(df.agg(F.count(F.lit(1)).alias("n"), types.cast("bigint").alias("n_types")).select(F.lit(name).alias("entity"), "n", "n_types"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def archive_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Number, timestep range and distinct types of recorded bond changes."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestep").alias("first_ts"), F.max("timestep").alias("last_ts"), F.count_distinct("bond_type").alias("n_types"))


def data_file_lines(atoms: DataFrame, bonds: DataFrame, masses: DataFrame, box) -> DataFrame:
    """(name, part, i, line) of sectioned data files, one per ``name`` (a system per file).

    atoms: name, atom_id, mol_id, type, x, y, z; bonds: name, bond_type, a1, a2; masses: type, mass.
    """
    edges = box if isinstance(box, (tuple, list)) else (box, box, box)
    names = atoms.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    head = [F.lit("# system"), F.format_string("%d atoms", F.col("_n"))] + [F.lit(f"0.0 {e} {ax}lo {ax}hi") for ax, e in zip("xyz", edges)] + [F.lit("")]
    marks = [(10, "Masses"), (20, "Atoms # molecular"), (30, "Bonds")]
    header = names.select("name", F.inline(F.array(
        *[F.struct(F.lit(k).alias("part"), text.alias("line")) for k, text in enumerate(head)],
        *[F.struct(F.lit(p).alias("part"), F.lit(f"\n{title}\n").alias("line")) for p, title in marks],
    ))).withColumn("i", F.lit(0).cast("bigint"))
    mass = atoms.select("name", "type").distinct().join(masses, "type")
    rows = [
        mass.select("name", F.lit(11).alias("part"), F.format_string("%d %.4f  # T%d", "type", "mass", "type").alias("line"), F.col("type").alias("i")),
        atoms.select("name", F.lit(21).alias("part"), F.format_string("%d %d %d %.6f %.6f %.6f", "atom_id", "mol_id", "type", "x", "y", "z").alias("line"), F.col("atom_id").alias("i")),
        bonds.select("name", F.lit(31).alias("part"), F.format_string("%d %d %d %d", "a1", "bond_type", "a1", "a2").alias("line"), F.col("a1").alias("i")),
    ]
    out = header.select("name", "part", "line", "i")
    for part in rows:
        out = out.unionByName(part)
    return out


def write_data_files(lines: DataFrame, path: str) -> None:
    spread(lines, "name").sortWithinPartitions("name", "part", "i").select("name", "line").write.partitionBy("name").mode("append").text(path)
