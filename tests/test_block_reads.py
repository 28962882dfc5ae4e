"""Files cut into blocks and pieces: frames and sections that lie in several tasks."""

import os

import pytest
from pyspark.sql import functions as F

from beadloom.sources import dump, tables
from beadloom.streaming import monitor


@pytest.fixture
def small_blocks(spark):
    """Blocks of about as many bytes as asked for."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], str(min(size, 64)))

    yield use
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def frames_text(frames):
    out = []
    for ts, box, ids in frames:
        out.append(f"ITEM: TIMESTEP\n{ts}\nITEM: NUMBER OF ATOMS\n{len(ids)}\nITEM: BOX BOUNDS pp pp pp\n0 {box}\n-1 {box}\n0.5 {box}\nITEM: ATOMS id type x y z\n")
        out += [f"{i} {i % 6 + 1} {i}.25 {ts}.5 {box}\n" for i in ids]
    return "".join(out)


def atoms_of(df):
    return sorted((r["timestep"], r["box"]["xhi"], r["box"]["ylo"], r["id"], r["type"], r["x"], r["y"], r["z"]) for r in df.collect())


@pytest.mark.parametrize("size", [190, 333, 100_000])
def test_frames_over_many_blocks(spark, tmp_path, small_blocks, size):
    frames = [(k * 7, 20 + k, range(1, n + 1)) for k, n in enumerate([60, 1, 0, 2, 140, 3, 3, 3, 40, 0, 5])]
    (tmp_path / "a.dump").write_text(frames_text(frames))
    (tmp_path / "b.dump").write_text(frames_text(frames[::-1]))
    want = sorted((ts, float(b), -1.0, i, i % 6 + 1, i + 0.25, ts + 0.5, float(b)) for ts, b, ids in frames for i in ids)
    small_blocks(size)
    lines = spark.read.text(str(tmp_path))
    if size < 1000:
        assert lines.select("_metadata.file_block_start").distinct().count() > 5
    got = dump.read_dump(spark, str(tmp_path))
    assert atoms_of(got.where(F.col("file").endswith("a.dump"))) == want
    assert atoms_of(got.where(F.col("file").endswith("b.dump"))) == want
    strided = dump.read_dump(spark, str(tmp_path), stride=4, max_frames=2).where(F.col("file").endswith("a.dump"))
    assert {(r["timestep"], r["frame"]) for r in strided.collect()} == {(0, 0), (28, 1)}


def test_a_frame_in_pieces_reads_as_written(spark, tmp_path, small_blocks):
    atoms = spark.range(1, 401).select(
        F.lit(50).cast("bigint").alias("timestep"), "id", (F.col("id") % 6 + 1).alias("type"), *[(F.col("id") % m).cast("double").alias(ax) for ax, m in zip("xyz", (7, 11, 13))])
    few = atoms.where("id <= 5")
    frames = atoms.unionByName(few.withColumn("timestep", F.lit(3).cast("bigint"))).unionByName(few.withColumn("timestep", F.lit(60).cast("bigint")))
    boxed = frames.withColumn("lx", (F.col("timestep") + 20).cast("double")).withColumn("ly", F.lit(30.5)).withColumn("lz", F.lit(9.0))
    path = str(tmp_path / "out")
    dump.write_dump(boxed, path, ("lx", "ly", "lz"), size=90)
    pieces = sorted(d for d in os.listdir(path) if d.startswith("piece="))
    manifest = {r["piece"]: r for r in spark.read.parquet(f"{path}/_manifest").collect()}
    assert len(pieces) > 5 and {p.removeprefix("piece=") for p in pieces} == set(manifest)
    assert sum(r["n_lines"] for r in manifest.values()) == 410 + 3 * 7
    small_blocks(400)
    got = dump.read_dump(spark, path)
    assert got.select("file").distinct().count() == 1
    want = sorted((r["timestep"], float(r["timestep"] + 20), 0.0, r["id"], r["type"], r["x"], r["y"], r["z"]) for r in frames.collect())
    assert atoms_of(got) == want
    # every other program: the pieces one after the other
    files = [os.path.join(path, d, f) for d in pieces for f in os.listdir(os.path.join(path, d)) if f.endswith(".txt")]
    whole = "".join(open(f).read() for f in files)
    frame = whole.split("ITEM: TIMESTEP\n")
    big = next(f for f in frame if f.startswith("50\n")).splitlines()
    assert big[4] == "0.00000000 70.00000000" and [int(line.split()[0]) for line in big[8:]] == list(range(1, 401))


def test_gro_rows_end_with_the_box_of_their_frame(spark, tmp_path):
    atoms = spark.createDataFrame([(t, i, 1, 1.0, 2.0, 3.0, 10.0 * (t + 1)) for t in (0, 1) for i in range(1, 8)], "timestep long, id long, type long, x double, y double, z double, l double")
    path = str(tmp_path / "gro")
    dump.write_rows(atoms, path, "timestep", "gro", "l", size=3)
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".txt"))
    text = "".join(open(f).read() for f in files).splitlines()
    assert [text[k] for k in (0, 1, 9, 10, 19)] == ["frame 0", "    7", "   1.00000   1.00000   1.00000", "frame 1", "   2.00000   2.00000   2.00000"]
    assert [int(line[15:20]) for line in text[2:9]] == list(range(1, 8))


def test_a_streamed_frame_in_pieces_gives_whole_beads(spark, tmp_path, small_blocks):
    """Only the first piece of a frame holds its header."""
    atoms = spark.range(1, 201).select(
        F.lit(50).cast("bigint").alias("timestep"), "id", F.lit(1).cast("bigint").alias("type"), (F.col("id") % 10).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    dump.write_dump(atoms, path, 30.0, size=45)
    assert len([d for d in os.listdir(path) if d.startswith("piece=")]) > 3
    small_blocks(300)
    bonds = atoms.where("id % 2 = 1").select(F.col("id").alias("a1"), (F.col("id") + 1).alias("a2"))
    mapping = atoms.select(F.col("id").alias("atom_id"), F.ceil(F.col("id") / 2).alias("bead_id"))
    masses = spark.createDataFrame([(1, 2.0)], "type long, mass double")
    monitor.run_available(dump.dump_stream(spark, path), "append", monitor.bead_frames_sink(bonds, mapping, masses, out), "beads")
    got = sorted((r["timestep"], r["bead_id"], r["mass"], r["x"], r["y"], r["z"]) for r in spark.read.parquet(out).collect())
    assert got == [(50, b, 4.0, ((2 * b - 1) % 10 + 2 * b % 10) / 2, 1.0, 2.0) for b in range(1, 101)]
