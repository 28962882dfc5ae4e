"""Line-oriented files read in many tasks, whose lines mean something only after an earlier line.

Spark cuts a text file into blocks at line ends. Inside a block the lines come in order, so what a line belongs to is
known from the last mark before it in the block; only lines before a block's first mark need what the blocks
before it end with. A first pass keeps that, one small row for each block, and a window over these rows hands it
on; the second pass joins it by block. A file may be larger than any task, and no line is shuffled.

A folder of pieces ``.../piece=<n>/...`` is one stream: its files in the order of their names are read as one file.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks whose rows may be sent to every executor (about 300 bytes each); beyond it the planner decides.
BROADCAST_BLOCKS = 500_000


def block_lines(spark: SparkSession, path, *more: Column, paths: bool = False, streaming: bool = False) -> DataFrame:
    """(path_id, block, line) of all lines under ``path``, in order inside a block; with more columns of ``line``, or the path of its file."""
    file = F.col("_metadata.file_path")
    columns = [F.xxhash64(file).alias("path_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")]
    reader = spark.readStream if streaming else spark.read
    lines = reader.option("recursiveFileLookup", True).text(path).select(*columns, *([file.alias("path")] if paths else []))
    return lines.select("*", *more)


def by_block(batches):
    """((path_id, block), iterator of batches) for each block of a task, in order."""

    def cut():
        for batch in batches:
            ids, starts = (batch.column(c).to_numpy() for c in ("path_id", "block"))
            edges = np.flatnonzero((ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1])) + 1
            for a, b in itertools.pairwise([0, *edges.tolist(), len(ids)]):
                if b > a:
                    yield (int(ids[a]), int(starts[a])), batch.slice(a, b - a)

    for key, parts in itertools.groupby(cut(), key=lambda part: part[0]):
        yield key, (part for _, part in parts)


def stream_name(path: str = "path") -> Column:
    """Folder of a file that is a piece of a stream, else the file."""
    return F.regexp_replace(path, r"/piece=[^/]*/[^/]*$", "")


def before(value, distance: int | None = None) -> Column:
    """The last ``value`` that is not null in the blocks (stream, path, block) before, or the one ``distance`` blocks before.

    Rows are one for each block, so those of a stream fit one task.
    """
    order = Window.partitionBy("stream").orderBy("path", "block")
    if distance is not None:
        return F.lag(value, distance).over(order)
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def with_block(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with the columns of their block (path_id, block, ...)."""
    small = blocks.count() <= BROADCAST_BLOCKS
    return lines.join(F.broadcast(blocks) if small else blocks, ["path_id", "block"])
