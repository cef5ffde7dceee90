"""Where documents go. A sink is a function of a batch frame; several can be fanned out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import mutations, shop
from corpusloom.sources import snapshots

Sink = Callable[[DataFrame], None]


def json_sink(path: str) -> Sink:
    """Append documents as JSON lines, one folder per run."""

    def write(docs: DataFrame) -> None:
        docs.write.partitionBy("spiderUUID").mode("append").json(path)

    return write


def document_sink(root: str) -> Sink:
    """Merge documents by id into the snapshot store; the newest gather time of the batch wins.

    A batch is appended as a delta: what is written is in proportion to the batch, and the store is not read. It is
    compacted when that is due.
    """

    def write(docs: DataFrame) -> None:
        spark = docs.sparkSession
        newest = mutations.last_written(docs)
        if snapshots.has_snapshot(spark, root):
            snapshots.write_delta(spark, root, newest)
            snapshots.compact(spark, root, only_if_due=True)
        else:
            snapshots.write_snapshot(newest, root)

    return write


def product_sink(path: str, domain: str) -> Sink:
    """Append the typed product records of one shop."""

    def write(docs: DataFrame) -> None:
        shop.typed_products(docs, domain).write.mode("append").parquet(path)

    return write


def as_messages(docs: DataFrame) -> DataFrame:
    """``key, value``: a document as one JSON message, in the columns message brokers expect."""
    return docs.select(F.col("id").alias("key"), F.to_json(F.struct(*docs.columns)).alias("value"))


def publish_sink(fmt: str, enabled: bool = True, **options: str) -> Sink:
    """One JSON message per document, to ``kafka`` in a deployment or to files."""

    def write(docs: DataFrame) -> None:
        if enabled:
            messages = as_messages(docs)
            if fmt == "text":
                messages = messages.select("value")
            messages.write.format(fmt).mode("append").options(**options).save()

    return write


def fan_out(docs: DataFrame, sinks: Sequence[Sink]) -> None:
    """Give every sink the same documents, worked out once. Blocks lost with an executor are recomputed."""
    kept = docs.persist()
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()
