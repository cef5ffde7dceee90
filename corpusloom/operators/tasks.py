"""Runs and their event log: listing, progress, states, retention and log entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_GAP_MS = 2000
#: The log of a task is worked on in pieces of this length, so that no task is one unit of work.
LOG_PIECE_MS = 60_000


def by_state(tasks: DataFrame, state: str, with_extra: bool = True) -> DataFrame:
    found = tasks.filter(F.col("state") == state)
    return found if with_extra else found.drop("extra")


def by_time(tasks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Tasks strictly between the two moments."""
    return tasks.filter((F.col("ts") > start) & (F.col("ts") < end))


def count_by_state(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("n"))


def run_progress(events: DataFrame) -> DataFrame:
    """Per run: pages handled, effective pages, start, and latest state."""
    return events.groupBy("run_id").agg(
        F.count("*").alias("n_pages"),
        F.sum(F.col("effective").cast("long")).alias("n_effective"),
        F.min("ts").alias("started"),
        F.max_by("state", F.struct("ts", "event_id")).alias("state"),
    )


def retained(tasks: DataFrame) -> DataFrame:
    """What the periodic clean-up leaves: all but stopped tasks."""
    return tasks.filter(~F.coalesce(F.col("state") == "STOP", F.lit(False)))


def deletion_verdicts(tasks: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested task ids with ``verdict``: deleted, refused (not stopped yet) or unknown."""
    state = tasks.select("task_id", "state")
    return requested.select("task_id").distinct().join(state, "task_id", "left").select(
        "task_id",
        F.when(F.col("state").isNull(), "unknown")
        .when(F.col("state") == "STOP", "deleted")
        .otherwise("refused")
        .alias("verdict"),
    )


# The state that may precede each state.
BEFORE = {"INIT": None, "RUNNING": "INIT", "STOP": "RUNNING"}


def latest_states(events: DataFrame) -> DataFrame:
    """Per task the latest state and its time."""
    last = F.max(F.struct("ts", "event_id", "state"))
    return events.groupBy("task_id").agg(last.alias("last")).select(
        "task_id", F.col("last.state").alias("state"), F.col("last.ts").alias("ts")
    )


def transitions(events: DataFrame) -> DataFrame:
    """Events (``task_id, event_id, ts, state``) with the state before them and whether that is legal.

    The previous state is looked up within the minute. Only the first event of a minute needs the last state of
    the minute before it, and only the first minute of a day that of the day before; those are one row per
    task and minute, or day. So a task with very many events is spread over its minutes. Events without a
    time come first.
    """
    at = F.coalesce(F.col("ts").cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    dated = events.withColumns({"_minute": F.date_trunc("minute", at), "_day": F.to_date(at)})
    within = Window.partitionBy("task_id", "_minute").orderBy("ts", "event_id")
    last = F.max(F.struct("ts", "event_id", "state")).alias("_last")
    minutes = dated.groupBy("task_id", "_day", "_minute").agg(last)
    days = minutes.groupBy("task_id", "_day").agg(F.max("_last").alias("_last"))
    over_days = Window.partitionBy("task_id").orderBy("_day")
    of_day = days.select("task_id", "_day", F.lag("_last.state").over(over_days).alias("_of_day"))
    over_minutes = Window.partitionBy("task_id", "_day").orderBy("_minute")
    of_minute = minutes.select("task_id", "_day", "_minute", F.lag("_last.state").over(over_minutes).alias("_of_minute"))
    carried = of_minute.join(of_day, ["task_id", "_day"]).select(
        "task_id", "_minute", F.coalesce("_of_minute", "_of_day").alias("_carried")
    )
    found = dated.withColumn("_lag", F.lag("state").over(within)).join(carried, ["task_id", "_minute"])
    previous = F.coalesce("_lag", "_carried")
    allowed = F.lit(False)
    for state, before in BEFORE.items():
        came_right = previous.isNull() if before is None else previous == before
        allowed = allowed | ((F.col("state") == state) & F.coalesce(came_right, F.lit(False)))
    return found.select("task_id", "event_id", "ts", "state", previous.alias("previous"), allowed.alias("is_legal"))


_EXIT = T.StructType([T.StructField("opens", T.IntegerType()), T.StructField("passes", T.IntegerType())])
#: What a stretch of a log passes on: the first exit that opens no earlier than entries may, or ``rest``.
#: ``starts`` and ``ends`` say whether it reaches its own borders, so that neighbours are really next to it.
_SUM = T.StructType(
    [
        T.StructField("piece", T.LongType()),
        T.StructField("starts", T.BooleanType()),
        T.StructField("ends", T.BooleanType()),
        T.StructField("rest", T.IntegerType()),
        T.StructField("exits", T.ArrayType(_EXIT)),
    ]
)
#: Pieces of an hour, and hours of a day.
_SPANS = (60, 24)


def _passed(summed: dict, blocked: int) -> int:
    return next((e["passes"] for e in summed["exits"] if e["opens"] >= blocked), summed["rest"])


def _shortest(exits: list[tuple[int, int]], rest: int) -> list[dict]:
    """The same exits with one for each run of equal ``passes``, and none where it would pass ``rest``."""
    kept: list[tuple[int, int]] = []
    for opens, passes in exits:
        if kept and kept[-1][1] == passes:
            kept.pop()
        kept.append((opens, passes))
    if kept and kept[-1][1] == rest:
        kept.pop()
    return [{"opens": o, "passes": p} for o, p in kept]


def _follow(sums, blocked: int) -> tuple[list[int], int]:
    """From which offset entries may open in each of the stretches, and what the last passes on."""
    allowed, last = [], None
    for own in sums:
        joined = own["starts"] and (last is None or (own["piece"] == last["piece"] + 1 and last["ends"]))
        blocked = blocked if joined else 0
        allowed.append(blocked)
        blocked, last = _passed(own, blocked), own
    return allowed, blocked


@F.pandas_udf(_SUM)
def _piece_sum(piece: pd.Series, times: pd.Series) -> pd.DataFrame:
    """What a piece passes on, by where its first entry may open.

    ``times`` are the message offsets inside the piece. If entries may open from offset o on, the
    piece's entries start at the first message not before o. Each such start among the first two
    seconds leads to one last entry; ``passes`` is how far that entry reaches into the next piece.
    """

    def one(number, offsets: np.ndarray):
        offsets = np.asarray(offsets)
        following = np.searchsorted(offsets, offsets + LOG_GAP_MS)
        reach = offsets + LOG_GAP_MS - LOG_PIECE_MS
        for i in range(len(offsets) - 1, -1, -1):
            if following[i] < len(offsets):
                reach[i] = reach[following[i]]
        starts = int(np.searchsorted(offsets, LOG_GAP_MS)) + 1
        exits = [(int(o), max(int(r), 0)) for o, r in zip(offsets[:starts], reach[:starts])]
        return (number, True, True, 0, _shortest(exits, 0))

    return pd.DataFrame([one(*row) for row in zip(piece, times)], columns=_SUM.names)


@F.pandas_udf(_SUM)
def _joined_sum(sums: pd.Series, span: pd.Series) -> pd.DataFrame:
    """The sum of a larger stretch from those inside it, in order."""

    def one(rows, size):
        first, last = rows[0], rows[-1]
        number = first["piece"] // size
        starts = bool(first["starts"] and first["piece"] == number * size)
        ends = bool(last["ends"] and last["piece"] == number * size + size - 1)

        def passes(blocked: int) -> int:
            return _follow(rows, blocked)[1] if ends else 0

        opens = [e["opens"] for e in first["exits"]] if starts else []
        rest = passes(max(opens, default=-1) + 1)
        return (number, starts, ends, rest, _shortest([(o, passes(o)) for o in opens], rest))

    return pd.DataFrame([one(*row) for row in zip(sums, span)], columns=_SUM.names)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _blocks(sums: pd.Series, blocked: pd.Series) -> pd.Series:
    """For the stretches inside a larger one: from which offset entries may open in each."""
    return pd.Series([_follow(*row)[0] for row in zip(sums, blocked)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _piece_anchors(times: pd.Series, piece: pd.Series, blocked: pd.Series) -> pd.Series:
    """The entry starts of one piece, in milliseconds."""

    def one(offsets, number, first):
        offsets = np.asarray(offsets)
        at, found = int(np.searchsorted(offsets, first)), []
        while at < len(offsets):
            found.append(int(number) * LOG_PIECE_MS + int(offsets[at]))
            at = int(np.searchsorted(offsets, offsets[at] + LOG_GAP_MS))
        return found

    return pd.Series([one(*row) for row in zip(times, piece, blocked)], dtype=object)


def log_anchors(messages: DataFrame) -> DataFrame:
    """``task_id, piece, anchors``: where log entries start (messages: ``task_id, ts_ms``).

    A message joins the entry whose start lies less than two seconds before it, so each entry
    depends on the one before. To keep one busy task from becoming one unit of work, its log is cut
    into one-minute pieces of distinct milliseconds (at most 60 000 values each). A piece is first
    summed up as "if entries may open from here, this is what I pass on". Sums are joined into sums of
    hours and days; the few days of a task are followed one after the other; then days tell hours,
    hours tell pieces, and every piece finds its own entries.
    """
    piece = F.floor(F.col("ts_ms") / LOG_PIECE_MS)
    pieces = (
        messages.select("task_id", piece.alias("piece"), (F.col("ts_ms") - piece * LOG_PIECE_MS).cast("int").alias("at"))
        .groupBy("task_id", "piece")
        .agg(F.sort_array(F.collect_set("at")).alias("times"))
    )
    sums = pieces.select("task_id", _piece_sum("piece", "times").alias("s"))
    levels = []
    for span in _SPANS:
        inside = sums.groupBy("task_id", F.floor(F.col("s.piece") / span).alias("larger")).agg(
            F.sort_array(F.collect_list("s")).alias("sums")
        )
        levels.append(inside)
        sums = inside.select("task_id", _joined_sum("sums", F.lit(span)).alias("s"))
    whole = sums.groupBy("task_id").agg(F.sort_array(F.collect_list("s")).alias("sums"))
    blocks = _inner_blocks(whole.withColumn("blocked", F.lit(0)))
    for inside in reversed(levels):
        blocks = _inner_blocks(inside.join(blocks.withColumnRenamed("piece", "larger"), ["task_id", "larger"]))
    return pieces.join(blocks, ["task_id", "piece"]).select(
        "task_id", "piece", _piece_anchors("times", "piece", "blocked").alias("anchors")
    )


def _inner_blocks(stretches: DataFrame) -> DataFrame:
    """``task_id, piece, blocked`` of what is inside stretches of known ``blocked``."""
    told = F.arrays_zip(F.col("sums.piece").alias("piece"), _blocks("sums", "blocked").alias("blocked"))
    return stretches.select("task_id", F.explode(told).alias("b")).select("task_id", "b.piece", "b.blocked")


def coalesce_log(messages: DataFrame) -> DataFrame:
    """``task_id, anchor_ms, n_messages, text``: messages (``task_id, seq, ts_ms, message``) as log entries.

    The texts of an entry are joined by ``<br/>`` in order of time, then ``seq``. Messages without a task or a time
    are left out.
    """
    placed = messages.withColumn("piece", F.floor(F.col("ts_ms") / LOG_PIECE_MS))
    anchors = log_anchors(messages)
    # An entry may have started in the piece before, so each piece also sees those starts.
    with_carried = anchors.select("task_id", "piece", "anchors").unionByName(
        anchors.select(
            "task_id",
            (F.col("piece") + 1).alias("piece"),
            F.array_compact(F.array(F.try_element_at("anchors", F.lit(-1)))).alias("anchors"),
        )
    )
    seen = with_carried.groupBy("task_id", "piece").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    anchor = F.array_max(F.filter("anchors", lambda a: a <= F.col("ts_ms")))
    return (
        placed.join(seen, ["task_id", "piece"])
        .withColumn("anchor_ms", anchor)
        .groupBy("task_id", "anchor_ms")
        .agg(
            F.count("*").alias("n_messages"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("ts_ms", "seq", "message"))), lambda m: m["message"]
                ),
                "<br/>",
            ).alias("text"),
        )
    )
