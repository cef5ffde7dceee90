"""Session settings, the shared working folder, and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits below which a lookup side may be copied to every executor.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
#: Short rows that a task of heavy work takes.
ROWS_A_TASK = 100_000
SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app_name: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, for sessions started without ``--py-files``."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # Executors fetch the archive from the driver for as long as the application runs.
    archive = Path(tempfile.mkdtemp(prefix="corpusloom-py-")) / "corpusloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
    context._corpusloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A local session without the setting
    gets a folder of its own; any other session without it is a configuration error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def new_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A path under ``folder``, or else under the shared folder, that nothing has been written to yet."""
    return f"{folder or f'{shared_dir(spark)}/corpusloom'}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside drop their shuffle files when they end; the setting is as before afterwards."""
    before = spark.conf.get(SHUFFLE_FILES, "false")
    spark.conf.set(SHUFFLE_FILES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_FILES, before)


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder that this package wrote; whether there was one."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table over all cores before work that is heavy per row.

    A file with one row group is read by one task. Tables that already come in at least as many
    splits as there are cores are left alone, so nothing large is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """Deal a table of short rows by its number of rows, for work that is heavy per row.

    Every core gets as many parts. Splits of its files say little: they may be few, or hold most of the rows in some and none in others.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-df.count() // (rows * cores))))


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    """Whether ``df`` is proven to stay inside the broadcast limits.

    Reads at most ``max_rows + 1`` rows of ``df``, so a huge side is recognised early.
    """
    row_bytes = F.length(F.to_json(F.struct("*")))
    n_rows, n_bytes = df.limit(max_rows + 1).agg(F.count("*"), F.sum(row_bytes)).first()
    return n_rows <= max_rows and (n_bytes or 0) <= max_bytes


def is_small_and(
    df: DataFrame, condition: Column, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> tuple[bool, bool]:
    """Whether ``df`` is inside the broadcast limits, and whether ``condition`` holds for any row.

    One job over the whole frame, for tables that are read in full anyway.
    """
    row_bytes = F.length(F.to_json(F.struct("*")))
    measured = df.select(row_bytes.alias("n"), condition.alias("found"))
    n_rows, n_bytes, found = measured.agg(F.count("*"), F.sum("n"), F.bool_or("found")).first()
    return n_rows <= max_rows and (n_bytes or 0) <= max_bytes, bool(found)


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough; otherwise unchanged.

    Without the hint the join is a sort-merge join that adaptive execution may split on skew.
    """
    return F.broadcast(df) if is_small(df, **limits) else df


def giving_back(run: Callable) -> Callable:
    """``run``, a function of batches, which at the end of a task gives freed memory back to the machine: a Python worker
    goes on to tasks of other stages, next to other workers that wait."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
