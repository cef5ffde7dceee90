"""Tables, intermediate results in the shared folder, and bounded bitmaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small, drop_path, giving_back, new_path, ship_package  # noqa: F401

#: Bits of the bitmaps that passes over the corpus hand to each other: 2 MB, whatever the corpus.
BITMAP_BITS = 1 << 24

#: What counts as white space between words: ``\x20`` and ``\x09-\x0D``, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch between Spark and Python, unless the session says otherwise: texts may be very long.
BATCH_ROWS = 1000
_BATCH_SETTING, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def prepare(spark: SparkSession) -> None:
    """Give the workers this package, and keep batches of texts small if the session leaves it open."""
    ship_package(spark)
    if spark.conf.get(_BATCH_SETTING) == _SPARK_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of the intermediate tables of the step that is being worked out, if it drops them at its end.
_STEP: ContextVar[str | None] = ContextVar("step", default=None)
_SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside drop their shuffle files when they end; the setting is as before afterwards."""
    before = spark.conf.get(_SHUFFLE_FILES, "false")
    spark.conf.set(_SHUFFLE_FILES, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_FILES, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from files, not from lineage."""
    return _write(df, path or new_path(df.sparkSession, label, _STEP.get()))


def settle(spark: SparkSession, label: str, step: Callable[[], DataFrame], into: str | None = None) -> DataFrame:
    """What ``step`` gives, written (to the folder ``into``, or else next to the tables of the step around it); the
    tables that it wrote on the way are deleted then."""
    kept, folder = new_path(spark, label, into or _STEP.get()), new_path(spark, f"{label}-step", _STEP.get())
    outer = _STEP.set(folder)
    try:
        return _write(step(), kept)
    finally:
        _STEP.reset(outer)
        drop_path(spark, folder)


#: Column of row numbers.
ROW = "__row"


def with_row_numbers(df: DataFrame, stored: bool = False) -> DataFrame:
    """``df`` with ``ROW``, a number for each row that stays the same.

    ``stored`` says that ``df`` is the rows of Parquet files as they are: the number is then made from the place
    in the files. Otherwise the rows are written once more, with their numbers.
    """
    if not stored:
        return materialise(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias(ROW))
    in_turn = Window.orderBy("__file")  # as many rows as files
    numbers = placed.select("__file").distinct().withColumn("__number", F.row_number().over(in_turn).cast("long"))
    numbered = placed.join(broadcast_if_small(materialise(numbers, "files")), "__file")
    return numbered.withColumn(ROW, F.shiftleft("__number", 36) + F.col(ROW)).drop("__file", "__number")


#: Rows of the tables of bits that ``take`` and ``leave`` may broadcast, each for 64 rows; their bytes are checked too.
BLOCKS_MAX = 1_000_000


def _blocks(chosen: DataFrame, copy: Column) -> DataFrame:
    """``__block, __bits``: 64 neighbouring row numbers in one, those of ``chosen`` as set bits; a row for each ``copy``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(ROW).bitwiseAND(63).cast("int"))
    bits = chosen.select(F.shiftright(ROW, 6).alias("__block"), copy.alias("__copy"), bit.alias("bit"))
    bits = bits.groupBy("__block", "__copy").agg(F.bit_or("bit").alias("__bits")).drop("__copy")
    return broadcast_if_small(bits, max_rows=BLOCKS_MAX)


def _in_block() -> Column:
    return F.getbit("__bits", F.col(ROW).bitwiseAND(63).cast("int")) == 1


def take(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` whose number is in ``chosen`` (``ROW``, and ``copies`` if more than one), as often as that says.

    Numbers of neighbouring rows travel as bits, so that the texts rarely have to be shuffled for them.
    """
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))) if "copies" in chosen.columns else F.lit(1)
    found = rows.withColumn("__block", F.shiftright(ROW, 6)).join(_blocks(chosen, copies), "__block")
    return found.filter(_in_block()).drop("__block", "__bits")


def leave(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` whose number is not in ``chosen``."""
    found = rows.withColumn("__block", F.shiftright(ROW, 6)).join(_blocks(chosen, F.lit(1)), "__block", "left")
    return found.filter(~F.coalesce(_in_block(), F.lit(False))).drop("__block", "__bits")


def in_fold(doc_id: Column, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo 5; a null id counts as empty text."""
    as_text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(as_text.cast("binary")) % 5 == fold


def bitmap_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero 64-bit words of a bitmap in which the bits of ``values`` are set."""
    bits = np.unique(values & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    words, starts = np.unique(bits >> 6, return_index=True)
    masks = np.uint64(1) << (bits & 63).astype(np.uint64)
    merged = np.bitwise_or.reduceat(masks, starts) if len(bits) else masks
    return words, merged.view(np.int64)


def collect_bitmap(df: DataFrame, word: str, bits: str) -> np.ndarray:
    """One bitmap from many; what comes to the driver is bounded by ``BITMAP_BITS``."""
    merged = df.groupBy(word).agg(F.bit_or(bits).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS >> 6, dtype=np.uint64)
    bitmap[merged[word].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return bitmap


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = values & np.uint64(BITMAP_BITS - 1)
    return (bitmap[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) != 0
