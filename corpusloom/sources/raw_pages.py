"""The table of fetched pages, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schema import RAW_PAGE


def as_raw_pages(df: DataFrame) -> DataFrame:
    """Give ``df`` the raw-page columns; missing ones are null."""
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RAW_PAGE.fields
        )
    )


def read_raw_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Parquet keeps its own column set, so unread columns cost nothing; text formats get a schema."""
    reader = spark.read.format(fmt)
    return as_raw_pages(reader.load(path) if fmt == "parquet" else reader.schema(RAW_PAGE).load(path))


def stream_raw_pages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    files: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New files under ``path`` as they arrive; ``files`` restricts the file names."""
    reader = spark.readStream.format(fmt).schema(RAW_PAGE)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
