"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("beadloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a folder given by ``setCheckpointDir`` counts, and in local mode a
    temporary one that is removed at exit. Anything else is an error: executors do not see
    what others write to a folder of one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "local" not in _LOCAL:
        _LOCAL["local"] = tempfile.mkdtemp(prefix="beadloom-")
        atexit.register(shutil.rmtree, _LOCAL["local"], ignore_errors=True)
    return _LOCAL["local"]


def job_dir(spark: SparkSession) -> str:
    """The application's own folder below the shared one; all its step tables and files are there."""
    return f"{shared_dir(spark).rstrip('/')}/beadloom-{spark.sparkContext.applicationId}"


def drop_steps(spark: SparkSession) -> None:
    """Removes the step tables of this application. Call it when the results that read them are stored."""
    folder = job_dir(spark)
    place, path = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    if place.get_file_info(path).type != fs.FileType.NotFound:
        place.delete_dir(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint that its next join is a shuffled one.

    The planner takes sizes from files. It does not see how many rows an explode makes of a small table, and would collect them on
    the driver for a broadcast.
    """
    return df.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` to as many tasks as a shuffle has, none of them merged.

    AQE merges tasks by compressed bytes, and a file is cut by its bytes: rows of numbers that compress well, or of which each makes
    many, pile up in a few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{job_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: survives the loss of executors.

    A written table also drops the constraints a checkpointed plan keeps (they
    grow from round to round in loops) and gives the planner real sizes. The tables
    stay until ``drop_steps``, as lazy results read them; the files that the job
    shuffled go as soon as it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of a job when it ends; else they stay until the driver's garbage collector finds the plan unused.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def drop_step(df: DataFrame) -> None:
    """Removes the table that ``cut_lineage`` gave as ``df``, once every job that reads it has run."""
    folder = job_dir(df.sparkSession)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place, path = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        if f"{folder.rsplit(':', 1)[-1].lstrip('/')}/step-" in path:
            place.delete_dir(path)
