"""Trajectory dump text as DataFrames, batch or streaming, and the way back.

Batch reads cut files into blocks, so a frame may lie in many tasks (``blocks``). Writes cut frames of more than
``PIECE_LINES`` lines into numbered pieces, each written by its own task, and pack smaller frames together.
"""

from __future__ import annotations

import time

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import bucketed_row_number
from ..operators.spatial import lengths
from ..session import cut_lineage, shuffled
from . import blocks as B

FRAME_MARK = "ITEM: TIMESTEP\n"
EDGES = ("xlo", "xhi", "ylo", "yhi", "zlo", "zhi")
HEADER_LINES = 9
PIECE_LINES = 1_000_000

_HEADER = "timestep long, " + ", ".join(f"{e} double" for e in EDGES) + ", names string"


# --- reading --------------------------------------------------------------------


def dump_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One row per frame: file, timestep, box, names of the atom columns and the atom lines. For frames that fit one task."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.option("lineSep", FRAME_MARK).option("recursiveFileLookup", True).text(path)
    return parse_frames(raw.select(F.col("_metadata.file_path").alias("file"), "value"))


def _bounds(lines: Column) -> Column:
    """Box edges from lines of a header without its first; a triclinic box fails the query."""
    head = F.get(lines, F.lit(3))
    bounds = F.when(head.contains("xy"), F.raise_error(F.lit("triclinic boxes are not supported")).cast("array<string>")).otherwise(F.slice(lines, 5, 3))
    edge = lambda axis, side: F.get(F.split(F.trim(F.get(bounds, F.lit(axis))), r"\s+"), F.lit(side)).cast("double")
    return F.struct(*[edge(k // 2, k % 2).alias(e) for k, e in enumerate(EDGES)])


def _names(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "^ITEM: ATOMS", ""))


def parse_frames(raw: DataFrame) -> DataFrame:
    frames = raw.withColumn("_t", F.regexp_replace("value", r"\s+$", "")).where("_t <> ''").withColumn("_l", F.split("_t", "\n"))
    return frames.select(
        "file", F.trim(F.get("_l", F.lit(0))).cast("bigint").alias("timestep"), _bounds(F.col("_l")).alias("box"),
        F.split(_names(F.get("_l", F.lit(7))), " +").alias("names"), F.slice("_l", 9, F.greatest(F.size("_l") - 8, F.lit(0))).alias("lines"),
    )


def frame_atoms(frames: DataFrame) -> DataFrame:
    """Frames to one row per atom; columns are taken by name from the frame's own header.

    Image flags are null where the header does not list them.
    """
    return _atoms(frames.select("file", "timestep", "box", "names", F.explode("lines").alias("line")))


def _atoms(rows: DataFrame, *more: str) -> DataFrame:
    rows = rows.withColumn("_v", F.split(F.trim("line"), r"\s+"))

    def named(name):
        at = F.array_position("names", name).cast("int")
        return F.when(at > 0, F.get("_v", at - 1))

    ints, reals, flags = ("id", "type"), ("x", "y", "z"), ("ix", "iy", "iz")
    return rows.select(
        "file", "timestep", "box", *more, *[named(c).cast("bigint").alias(c) for c in ints],
        *[named(c).cast("double").alias(c) for c in reals], *[named(c).cast("int").alias(c) for c in flags],
    )


class _Block:
    """What the lines of one block are: (n, lines) of atom lines after the block's n-th own header, n = 0 before the first.

    ``head`` are the lines before the first own header that belong to a header begun in the block before, ``headers`` the lines of
    the own ones; the last of them is cut short if the block ends in it.
    """

    def __init__(self):
        self.head, self.headers, self.in_header, self.known, self.waiting = [], [], False, False, None

    def feed(self, lines: pa.Array, last: bool = False):
        if self.waiting is not None:
            lines, self.waiting = pa.concat_arrays([self.waiting, lines]), None
        marks = pc.indices_nonzero(pc.starts_with(lines, "ITEM:")).to_pylist()
        if not self.known:
            if not marks and len(lines) < HEADER_LINES and not last:
                self.waiting = lines  # too few to tell atoms from a header that goes on
                return
            self.known = True
            self.in_header = bool(marks) and not lines[marks[0]].as_py().startswith("ITEM: TIMESTEP")
        at = 0
        while at < len(lines):
            if self.in_header:
                end = next((m + 1 for m in marks if m >= at and lines[m].as_py().startswith("ITEM: ATOMS")), len(lines))
                (self.headers[-1] if self.headers else self.head).extend(lines[at:end].to_pylist())
                self.in_header = end == len(lines) and not self._complete()
            else:
                end = next((m for m in marks if m >= at), len(lines))
                if end > at:
                    yield len(self.headers), lines[at:end]
                if end < len(lines):
                    self.headers.append([])
                    self.in_header = True
            at = end

    def finish(self):
        if self.waiting is not None:
            yield from self.feed(pa.array([], pa.string()), last=True)

    def _complete(self) -> bool:
        own = self.headers[-1] if self.headers else self.head
        return own[-1].startswith("ITEM: ATOMS")


def _block_heads(batches):
    """(path_id, block, path, n, text, done): headers begun in each block, and as n = 0 what a block has of the header before."""
    for key, parts in B.by_block(batches):
        block, path = _Block(), None
        for part in parts:
            path = part.column("path")[0].as_py()
            for _ in block.feed(part.column("line")):
                pass
        for _ in block.finish():
            pass
        texts = ["\n".join(block.head)] + ["\n".join(h) for h in block.headers]
        done = [True] * len(texts)
        done[-1] = not block.in_header
        yield pa.RecordBatch.from_pydict(
            {
                "path_id": [key[0]] * len(texts), "block": [key[1]] * len(texts), "path": [path] * len(texts),
                "n": pa.array(range(len(texts)), pa.int32()), "text": texts, "done": done,
            }
        )


def _header(lines: list[str]) -> dict:
    if "xy" in lines[4]:
        raise ValueError("triclinic boxes are not supported")
    edges = [float(v) for line in lines[5:8] for v in line.split()[:2]]
    return {"timestep": int(lines[1]), **dict(zip(EDGES, edges, strict=True)), "names": lines[8].removeprefix("ITEM: ATOMS").strip()}


def _block_atoms(batches):
    """(path_id, block, header, line): atom lines; the header is null for lines that go on with the frame of the block before."""

    def named(key, block, n, lines):
        header = _header(block.headers[n - 1]) if n else dict.fromkeys(["timestep", *EDGES, "names"])
        kinds = {"timestep": pa.int64(), "names": pa.string()}
        columns = {"path_id": key[0], "block": key[1], **header}
        out = {c: pa.repeat(pa.scalar(v, pa.int64() if c in ("path_id", "block") else kinds.get(c, pa.float64())), len(lines)) for c, v in columns.items()}
        return pa.RecordBatch.from_pydict({**out, "line": lines})

    for key, parts in B.by_block(batches):
        block = _Block()
        for part in parts:
            for n, lines in block.feed(part.column("line")):
                yield named(key, block, n, lines)
        for n, lines in block.finish():
            yield named(key, block, n, lines)


def _parsed_header(text: Column) -> Column:
    lines = F.split(text, "\n")
    rest = F.slice(lines, 2, 8)
    return F.when(
        text.isNotNull(),
        F.struct(F.trim(F.get(rest, F.lit(0))).cast("bigint").alias("timestep"), _bounds(rest).alias("box"), _names(F.get(rest, F.lit(7))).alias("names")),
    )


def scan_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, frames) of lines with their path: for each block the frame that goes on in it as ``carry``; (file, timestep) of every frame."""
    rows = cut_lineage(lines.mapInArrow(_block_heads, "path_id long, block long, path string, n int, text string, done boolean"))
    last = F.max_by(F.struct("n", "text", "done"), "n")
    per = rows.groupBy("path_id", "block", "path").agg(F.max(F.when(F.col("n") == 0, F.col("text"))).alias("head"), last.alias("last"))
    own = F.when((F.col("last.n") > 0) & F.col("last.done"), F.col("last.text"))
    begun = F.when((F.col("last.n") > 0) & ~F.col("last.done"), F.col("last.text"))
    per = per.select("path_id", "block", "path", B.stream_name().alias("stream"), "head", own.alias("own"), begun.alias("begun"))
    joined = per.withColumn("_open", B.before("begun", 1)).withColumn("whole", F.when(F.col("_open").isNotNull(), F.concat_ws("\n", "_open", "head")))
    # a header that the block completes counts before its own ones
    carry = F.coalesce("whole", B.before(F.coalesce("own", "whole")))
    blocks = cut_lineage(joined.select("path_id", "block", F.col("stream").alias("file"), _parsed_header(carry).alias("carry"), _parsed_header(F.col("whole")).alias("whole")))
    heads = rows.where("n > 0 AND done").select(B.stream_name().alias("file"), _parsed_header(F.col("text")).alias("h"))
    frames = heads.unionByName(blocks.where("whole IS NOT NULL").select("file", F.col("whole").alias("h"))).select("file", "h.timestep").distinct()
    return blocks.drop("whole"), frames


def _framed(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Atom lines with file, timestep, box and names of their frame."""
    lines = lines.mapInArrow(_block_atoms, f"path_id long, block long, {_HEADER}, line string").where("trim(line) <> ''")
    own_box = F.struct(*EDGES)
    return B.with_block(lines, blocks).select(
        "file", F.coalesce("timestep", "carry.timestep").alias("timestep"), F.when(F.col("timestep").isNotNull(), own_box).otherwise(F.col("carry.box")).alias("box"),
        F.split(F.coalesce("names", "carry.names"), " +").alias("names"), "line",
    )


def dump_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of dump files as they land, for ``landed_atoms``. The pieces of a frame must land in one micro-batch."""
    return B.block_lines(spark, path, paths=True, streaming=True)


def landed_atoms(batch: DataFrame) -> DataFrame:
    """Atoms of a micro-batch of ``dump_stream``; as in ``read_dump`` a frame may lie in any number of blocks and pieces."""
    blocks, _ = scan_blocks(batch)
    return _atoms(_framed(batch.drop("path"), blocks))


def read_dump(spark: SparkSession, path: str, max_frames: int | None = None, stride: int = 1) -> DataFrame:
    """Atoms of every ``stride``-th frame per file, at most ``max_frames`` frames.

    A frame may lie in any number of blocks, and a header may be cut by a block's end (blocks hold a header or more).
    Lines of frames that are left out are dropped before they are parsed.
    """
    blocks, frames = scan_blocks(B.block_lines(spark, path, paths=True))
    rows = _framed(B.block_lines(spark, path), blocks)
    if stride > 1 or max_frames is not None:
        kept = strided_frames(frames, ["file"], stride, max_frames)
        return _atoms(rows.join(kept, ["file", "timestep"]), "frame")
    return _atoms(rows)


def strided_frames(frames: DataFrame, keys: list[str], stride: int = 1, max_frames: int | None = None, order: str = "timestep",
                   block: int = 1000000) -> DataFrame:
    """Every ``stride``-th frame per run, renumbered from 0, at most ``max_frames`` of them."""
    numbered = bucketed_row_number(frames, keys, F.floor(F.col(order) / F.lit(block)), [order], "_n")
    kept = numbered.withColumn("_i", F.col("_n") - 1).where(F.col("_i") % stride == 0)
    kept = kept.withColumn("frame", F.floor(F.col("_i") / F.lit(stride))).drop("_n", "_i")
    return kept if max_frames is None else kept.where(F.col("frame") < max_frames)


def checked_frames(atoms: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Size per frame; ids that are not exactly 1..N fail the query."""
    sizes = atoms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_atoms"), F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi"), F.count_distinct(id_col).alias("_d"))
    ok = (F.col("_lo") == 1) & (F.col("_hi") == F.col("n_atoms")) & (F.col("_d") == F.col("n_atoms"))
    fail = F.raise_error(F.lit("atom ids are not 1..N")).cast("bigint")
    return sizes.select(*keys, F.when(ok, F.col("n_atoms")).otherwise(fail).alias("n_atoms"))


# --- writing --------------------------------------------------------------------

BODY = 8


def _edges(box) -> list[Column]:
    return [F.first(v) if isinstance(v, str) else F.lit(v) for v in lengths(box)]


def dump_lines(atoms: DataFrame, box, frame: str = "timestep", images: bool = False, by: list[str] | tuple = ()) -> DataFrame:
    """(by, frame, part, id, line): header lines are parts 0..6, atom lines part 8.

    ``box`` is one edge or three: numbers, or names of columns of the atoms that hold the edges of their frame.
    """
    cols = "id type x y z" + (" ix iy iz" if images else "")
    heads = atoms.groupBy(*by, frame).agg(F.count(F.lit(1)).alias("_n"), *[e.alias(f"_{ax}") for ax, e in zip("xyz", _edges(box))])
    bounds = F.concat_ws("\n", *[F.format_string("%.8f %.8f", F.lit(0.0), f"_{ax}") for ax in "xyz"])
    texts = [
        F.lit("ITEM: TIMESTEP"), F.col(frame).cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("_n").cast("string"), F.lit("ITEM: BOX BOUNDS pp pp pp"),
        bounds, F.lit(f"ITEM: ATOMS {cols}"),
    ]
    header = heads.select(*by, frame, F.posexplode(F.array(*texts)).alias("part", "line")).withColumn("id", F.lit(0).cast("bigint"))
    fmt, args = "%5d %5d %8.3f %8.3f %8.3f", ["id", "type", "x", "y", "z"]
    if images:
        fmt, args = fmt + " %4d %4d %4d", [*args, "ix", "iy", "iz"]
    body = atoms.select(*by, frame, F.lit(BODY).alias("part"), F.format_string(fmt, *args).alias("line"), F.col("id"))
    return header.select(*by, frame, "part", "id", "line").unionByName(body.select(*by, frame, "part", "id", "line"))


def with_pieces(lines: DataFrame, frame: str, body: int = BODY, by: list[str] | tuple = (), size: int = PIECE_LINES) -> DataFrame:
    """Lines with the name of their piece: in the order of names, and of (frame, part, id) inside one, every frame is in one row.

    Frames of more than ``size`` atoms are cut by id into pieces of their own, of about that many lines if ids are spread
    evenly; smaller frames are packed whole, about ``size`` lines to a piece if timesteps are. Names follow from the data
    alone, so a task that runs again writes the same piece.
    """
    ids = F.when(F.col("part") == body, F.col("id"))
    frames = lines.groupBy(*by, frame).agg(F.count(F.lit(1)).alias("_lines"), F.count(ids).alias("_n"), F.min(ids).alias("_lo"), F.max(ids).alias("_hi"))
    span = F.struct(F.sum("_lines").alias("total"), F.min(frame).alias("first"), F.max(frame).alias("last")).alias("_s")
    plan = frames.join(frames.groupBy(*by).agg(span), list(by)) if by else frames.withColumn("_s", frames.agg(span).scalar())
    since, cut = F.col(frame) - F.col("_s.first"), F.ceil(F.col("_n") / F.lit(size))
    group = F.floor(since.cast("double") / (F.col("_s.last") - F.col("_s.first") + 1).cast("double") * F.ceil(F.col("_s.total") / F.lit(size)))
    plan = cut_lineage(plan.select(*by, frame, group.alias("_g"), F.when(cut > 1, since + 1).otherwise(0).alias("_f"), cut.alias("_cut"), "_lo", "_hi"))
    within = F.floor((F.col("id") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1).cast("double") * F.col("_cut"))
    place = F.when(F.col("part") < body, F.lit(0)).when(F.col("part") > body, F.greatest(F.col("_cut") - 1, F.lit(0))).otherwise(within)
    name = F.format_string("%010d-%016d-%08d", "_g", "_f", place)
    # One row a frame: the lines, whose number the planner may not know, stay where they are unless frames are very many.
    planned = lines.join(F.broadcast(plan), [*by, frame]) if plan.count() <= B.BROADCAST_BLOCKS else shuffled(lines).join(plan, [*by, frame])
    return planned.withColumn("piece", name).drop("_g", "_f", "_cut", "_lo", "_hi")


def _write_pieces(lines: DataFrame, path: str, frame: str, body: int, by: list[str] | tuple, size: int) -> None:
    """Pieces below ``path``, one folder each, and a manifest (piece, first and last frame, number of lines) once all are there."""
    number = F.lit(f"{time.time_ns():020d}-")  # a later write to the same folder comes after this one
    pieces = with_pieces(lines, frame, body, by, size).withColumn("piece", F.concat(number, "piece"))
    ordered = pieces.repartition(*by, "piece").sortWithinPartitions(*by, "piece", frame, "part", "id")
    ordered.select(*by, "piece", "line").write.partitionBy(*by, "piece").mode("append").text(path)
    manifest = pieces.groupBy(*by, "piece").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("n_lines"))
    manifest.write.mode("append").parquet(f"{path}/_manifest")


def write_dump(atoms: DataFrame, path: str, box, frame: str = "timestep", images: bool = False, by: list[str] | tuple = (), size: int = PIECE_LINES) -> None:
    """Frames as dump text, a folder for each value of ``by``; a frame of more than ``size`` atoms lies in several pieces.

    ``read_dump`` reads pieces as one stream; other programs get the files of the manifest one after the other.
    """
    _write_pieces(dump_lines(atoms, box, frame, images, by), path, frame, BODY, by, size)


def row_lines(atoms: DataFrame, frame: str, form: str = "xyz", box=0.0) -> DataFrame:
    """(frame, part, id, line) of xyz rows in angstrom with T<type> names, or of fixed-width gro rows in nm.

    gro rows carry ``mol_id`` where the atoms have one, and end with the edges of the frame's box.
    """
    heads = atoms.groupBy(frame).agg(F.count(F.lit(1)).alias("_n"), *[e.alias(f"_{ax}") for ax, e in zip("xyz", _edges(box))])
    zero = F.lit(0).cast("bigint").alias("id")
    title = F.format_string("%d\nframe %d" if form == "xyz" else "frame %2$d\n%1$5d", F.col("_n"), F.col(frame))
    header = heads.select(F.col(frame), F.lit(0).alias("part"), zero, title.alias("line"))
    name = F.concat(F.lit("T"), F.col("type").cast("string"))
    if form == "xyz":
        line = F.format_string("%s %.6f %.6f %.6f", name, "x", "y", "z")
    else:
        nm = [F.col(ax) / 10.0 for ax in "xyz"]
        mol = F.col("mol_id" if "mol_id" in atoms.columns else "id")
        edges = F.format_string("%10.5f%10.5f%10.5f", *[F.col(f"_{ax}") / 10.0 for ax in "xyz"])
        header = header.unionByName(heads.select(F.col(frame), F.lit(2).alias("part"), zero, edges.alias("line")))
        line = F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", mol % 100000, F.lit("MOL"), name, F.col("id") % 100000, *nm)
    return header.unionByName(atoms.select(F.col(frame), F.lit(1).alias("part"), F.col("id"), line.alias("line")))


def write_rows(atoms: DataFrame, path: str, frame: str, form: str = "xyz", box=0.0, size: int = PIECE_LINES) -> None:
    """Frames as ordered rows of ``row_lines``, in pieces as ``write_dump`` writes them."""
    _write_pieces(row_lines(atoms, frame, form, box), path, frame, 1, (), size)
