"""Continuous collection, run-lifetime de-duplication, live counters and log entries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.operators.tasks import LOG_GAP_MS
from corpusloom.plans.collect import Analysis, Recipe, general_recipe, process
from corpusloom.sources.sinks import Sink

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def collect_stream(
    pages: DataFrame,
    templates: DataFrame,
    sinks: Sequence[Sink],
    run_id: str,
    gather_time: Callable[[], datetime] | datetime,
    checkpoint: str,
    recipe: Recipe = general_recipe,
    analysis: Analysis | None = None,
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Every micro-batch goes through recipe, analysis and every sink.

    ``trigger`` is what ``writeStream.trigger`` takes, for example ``{"processingTime": "1 minute"}``; without it
    the stream ends when all that is there has been read. An analysis sees the documents of its batch; give
    one that reads stored statistics if it needs those of the corpus.

    The document sink merges by id, so a batch that is repeated after a failure changes nothing.
    Sinks that append may see it twice.
    """

    def one_batch(batch: DataFrame, _: int) -> None:
        at = gather_time() if callable(gather_time) else gather_time
        process(batch, templates, sinks, run_id, at, recipe, analysis)

    return (
        pages.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drop_run_state(spark: SparkSession, checkpoint: str) -> bool:
    """Delete the progress and URL state of a run that has ended; whether there was any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unseen_urls(links: DataFrame, within: str | None = None, time_column: str = "found_at") -> DataFrame:
    """Each URL once per run. With ``within``, the state of a URL is dropped after that long; all of it goes
    with ``drop_run_state`` at the end of the run."""
    if within is None:
        return links.dropDuplicates(["run_id", "url"])
    return links.withWatermark(time_column, within).dropDuplicatesWithinWatermark(["run_id", "url"])


def run_counters(pages: DataFrame) -> DataFrame:
    """Live counts per run, for output mode ``update``."""
    return pages.groupBy("run_id").agg(
        F.count("*").alias("n_pages"), F.sum(F.col("effective").cast("long")).alias("n_effective")
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk and in their checkpoint; stateful processors
    need that. The setting is as before afterwards."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)


class LogEntries(StatefulProcessor):
    """Messages of one task as log entries.

    The state has the messages of entries that aren't over. An entry is opened by the earliest of them, and is
    over when the watermark has passed its start by two seconds: no message of it can come any more. A timer
    waits for that moment, so an entry is emitted whether or not its task sends anything more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_ms bigint, seq bigint, message string")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            part = part.dropna(subset=["ts_ms"])
            if len(part):
                least = int(part["ts_ms"].min())
                earliest = least if earliest is None else min(earliest, least)
                self.waiting.appendList(
                    [(int(t), None if pd.isna(s) else int(s), m) for t, s, m in zip(part["ts_ms"], part["seq"], part["message"])]
                )
        if earliest is not None:
            self._wait(earliest)
        yield pd.DataFrame(columns=_ENTRY)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda m: (m[0], m[1] is not None, m[1]))
        found, at = [], 0
        while at < len(waiting) and waiting[at][0] + LOG_GAP_MS <= passed:
            end = at
            while end < len(waiting) and waiting[end][0] < waiting[at][0] + LOG_GAP_MS:
                end += 1
            texts = [m[2] for m in waiting[at:end] if m[2] is not None]
            found.append((key[0], waiting[at][0], end - at, "<br/>".join(texts)))
            at = end
        self.waiting.clear()
        self.due.clear()
        if at < len(waiting):
            self.waiting.put(waiting[at:])
            self._wait(waiting[at][0])
        yield pd.DataFrame(found, columns=_ENTRY)

    def close(self) -> None:
        pass

    def _wait(self, earliest: int) -> None:
        """One timer: for the end of the entry that is over first."""
        at = earliest + LOG_GAP_MS
        if self.due.exists():
            due = self.due.get()[0]
            if due <= at:
                return
            self.handle.deleteTimer(due)
        self.handle.registerTimer(at)
        self.due.update((at,))


_ENTRY = ["task_id", "anchor_ms", "n_messages", "text"]


def log_stream(messages: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """``task_id, anchor_ms, n_messages, text``: messages (``task_id, seq, ts_ms, message``) as log entries, each
    once, when it is over. What comes out is what ``tasks.coalesce_log`` makes of the same messages, without
    entries that the watermark hasn't passed yet.

    Messages may come out of order by ``lateness``; later ones than that are dropped, and so is a message without
    a task or a time. The state is the messages of open entries. Start the stream inside ``rocksdb_state``.
    """
    timed = messages.filter("task_id is not null").select("task_id", F.col("seq").cast("long").alias("seq"), "ts_ms", "message")
    timed = timed.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", lateness)
    return timed.groupBy("task_id").transformWithStateInPandas(
        LogEntries(),
        outputStructType="task_id string, anchor_ms bigint, n_messages bigint, text string",
        outputMode="append",
        timeMode="eventTime",
    )
