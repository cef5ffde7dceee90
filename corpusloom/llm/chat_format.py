"""Conversations as training windows: marked turns, budgeted spans with history, and a loss mask.

A turn is written ``### role: text</turn>`` and a line feed. A backslash goes before every backslash and
control string inside a role or text, so marks can't be imitated and the text can be read back.

Running sums of turn tokens cut a conversation into spans of whole turns. A window is the leading system
turn, if there is one, then as many of the turns before the span as fit into the history budget, then the
span. A system turn that fills the budget by itself is written once, in the first window, and not repeated.
Only assistant texts of the span itself are under the loss mask; what is repeated is masked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD

#: Tokens (words, and one for the marks) of a window, and of what it repeats from before its span.
BUDGET = 1024
HISTORY = 256
SYSTEM, TARGET = "system", "assistant"

_OPEN, _CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.DOTALL)

_WINDOWS = "conv_id long, window int, repeated int, text string, loss array<struct<start:int,end:int>>"
_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its text begins and ends."""
    head = f"{_OPEN}{_ROLE_CONTROL.sub(lambda m: chr(92) + m[0], role)}: "
    body = escape(text)
    return f"{head}{body}{_CLOSE}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the place of the text, of every turn."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        yield unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)
        at = found.end()


class _Conversation:
    """Turns one by one to windows; holds one span and the history, not the conversation."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.before: list[tuple] = []
        self.span: list[tuple] = []
        self.used = self.number = self.seen = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        turn = (role, text, tokens)
        if self.span and self.used + tokens > self.budget:
            yield self.window()
        self.span.append(turn)
        self.used += tokens
        if not self.seen and role == SYSTEM and tokens < self.budget:
            self.system = turn
        self.seen += 1

    def window(self) -> dict:
        repeated = [self.system] if self.system and self.number else []
        repeated += self.before
        text, loss = [], []
        at = 0
        for k, (role, body, _) in enumerate(repeated + self.span):
            turn, start, end = format_turn(role, body)
            if k >= len(repeated) and role == TARGET:
                loss.append({"start": at + start, "end": at + end})
            text.append(turn)
            at += len(turn)
        out = {"conv_id": self.conv_id, "window": self.number, "repeated": len(repeated), "text": "".join(text), "loss": loss}
        self._carry()
        return out

    def _carry(self) -> None:
        """Keep the latest turns that fit into the history, and count what the next window repeats."""
        kept, room = [], self.history
        latest = self.before + self.span
        for turn in reversed(latest):
            if turn is self.system or turn[2] > room:
                break
            kept.insert(0, turn)
            room -= turn[2]
        self.before, self.span = kept, []
        self.number += 1
        self.used = sum(t[2] for t in kept) + (self.system[2] if self.system else 0)


def _windower(budget: int, history: int) -> Callable:
    """Rows come sorted by conversation and turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("window", pa.int32()), ("repeated", pa.int32()), ("text", pa.string()),
             ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        )
        current: _Conversation | None = None
        for batch in batches:
            out = []
            for conv_id, role, text, tokens in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        out.append(current.window())
                    current = _Conversation(conv_id, budget, history)
                out.extend(current.add(role, text, tokens))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.window()], schema=schema)

    return run


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``(conv_id, window, repeated, text, loss)``: the windows of every conversation in order.

    ``text`` begins with ``repeated`` turns that earlier windows have too; ``loss`` gives the spans of code
    points under the loss mask. Needs ``conv_id, turn, role, text``; other columns are not looked at.

    Turns come by ``turn``, null first, ties by role and text, so reruns agree; repeated rows are turns each.
    Null roles and texts count as empty. Rows without a conversation form one of their own. A turn of more
    tokens than the budget is a window by itself, with what it repeats: no turn is cut or dropped. An empty
    table gives an empty one. A conversation is read as a stream: one task orders it, none holds it.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.regexp_count("text", F.lit(WORD)) + 1).alias("tokens"),
        "turn",
    ).withColumn("tokens", F.coalesce("tokens", F.lit(1)).cast("long"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "tokens").mapInArrow(_windower(budget, history), _WINDOWS)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their windows, sorted by conversation and window."""
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    state: list | None = None

    def row() -> pa.RecordBatch:
        conv_id, n, turns, loss_chars, loss, chars = state
        values = [conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array([v], type=k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        for window in batch.to_pylist():
            if state is None or state[0] != window["conv_id"]:
                if state is not None:
                    yield row()
                state = [window["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = window["text"]
            for k, (role, body, _, _) in enumerate(parse(text)):
                if k >= window["repeated"]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
            for span in window["loss"]:
                target = unescape(text[span["start"] : span["end"]])
                state[3] += len(target)
                state[4].update(target.encode())
            state[5] += len(text)
    if state is not None:
        yield row()


def read_back(windows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of stored windows."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "window", "repeated", "text", "loss").mapInArrow(_reader, _DIGESTS)
