"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees over words.

The suffixes of all documents, one for each place where a window of words begins, are dealt into groups
that fit in memory; in each group a suffix tree is grown from the root to the depth of the window. Its deep
internal nodes are the windows that several suffixes begin with; neighbouring windows join into the maximal
repeats of a document, and every repeat that begins in a document with a smaller id goes.

Which group a suffix is in depends on its first words only, so suffixes that begin with the same window always
meet. The prefix that names a group has a variable length. As a rule it is the *seed*, the least of the
hashes of all runs of ``SEED`` words inside the window: neighbouring suffixes mostly share it and travel
together as one piece of text, instead of fifty words for every word. A seed with more than ``GROUP`` places
would make a group too large for memory; its suffixes are dealt by the longest prefix, the whole window, whose
group is one node of the tree and is summed up as such, wherever its members lie.

Suffixes whose seed is in one document only are leaves above the depth of the window and never travel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, prepare
from corpusloom.llm.words import CHUNK_BYTES, buffers, mix, place_hashes, spans, word_places

#: Words of a window, and of the runs whose least hash names a group.
WINDOW = 50
SEED = 16
#: Places of a seed that are taken into one group.
GROUP = 1 << 14
#: Windows of one travelling piece, and words that a tree is grown over at once; a group is never divided.
PIECE = 1024
WORDS_AT_ONCE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = "seed long, id long, version long"
_SUFFIXES = "prefix long, id long, version long, first long, n int, piece binary"
_REPEATS = "id long, version long, first long, n int"
_KEPT = "id long, n_words long, n_removed long, kept string"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass
class Places:
    """The words of some texts, or of a part of one long text."""

    text: np.ndarray  # number of the text of each word
    number: np.ndarray  # number of each word in its text
    starts: np.ndarray  # where it begins and ends in the bytes of the column
    ends: np.ndarray
    hashes: np.ndarray


def places_of(column: pa.Array) -> Iterator[Places]:
    """Words of a column, unchanged, a megabyte at a time; the parts of a long text overlap by a window less one."""
    bounds, raw = buffers(column)
    for first, last in spans(bounds, CHUNK_BYTES):
        low, high = int(bounds[first]), int(bounds[last])
        if high - low <= CHUNK_BYTES:
            cuts = bounds[first : last + 1] - low
            yield _cut(raw[low:high], cuts, low, first, np.zeros(last - first, dtype=np.int64))
            continue
        at, number, size = low, 0, CHUNK_BYTES
        while True:
            end = min(at + size, high)
            if end < high:
                gap = np.flatnonzero(_is_space(raw[at:end]))
                end = at + int(gap[-1]) if len(gap) else at
            part = _cut(raw[at:end], np.array([0, end - at]), at, first, np.array([number]))
            if end < high and len(part.starts) < 2 * WINDOW:
                size *= 2
                continue
            yield part
            if end == high:
                break
            number, at, size = number + len(part.starts) - WINDOW + 1, int(part.starts[1 - WINDOW]), CHUNK_BYTES


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _cut(data: np.ndarray, cuts: np.ndarray, low: int, first: int, numbers: np.ndarray) -> Places:
    """Words of the texts between ``cuts``; word ``numbers[k]`` of text k is its first here."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Places(none, none, none, none, np.zeros(0, dtype=np.uint64))
    starts, ends = word_places(data, cuts)
    inside = np.searchsorted(starts, cuts)
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(inside))
    number = np.arange(len(starts)) - inside[text] + numbers[text]
    return Places(text + first, number, starts + low, ends + low, place_hashes(data, starts, ends))


def runs_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    found = hashes[:n].copy()
    for k in range(1, size):
        found *= _BASE
        found += hashes[k : n + k]
    return mix(found)


def least_of_next(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbouring values."""
    width, least = 1, values
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = size - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def seed_runs(words: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes of one text with the same seed: (seed, word they begin at, how many)."""
    none = np.zeros(0, dtype=np.int64)
    if len(words.hashes) < WINDOW:
        return np.zeros(0, dtype=np.uint64), none, none
    seeds = least_of_next(runs_hash(words.hashes, SEED), WINDOW - SEED + 1)
    whole = words.text[: len(seeds)] == words.text[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), none, none
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (np.diff(at) > 1) | (seeds[at[1:]] != seeds[at[:-1]]) | (words.text[at[1:]] != words.text[at[:-1]])
    begins = np.flatnonzero(opens)
    n = np.diff(np.append(begins, len(at)))
    # Long runs, as of one word said again and again, travel in parts.
    parts = -(-n // PIECE)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begins, n = np.repeat(begins, parts) + part * PIECE, np.minimum(np.repeat(n, parts) - part * PIECE, PIECE)
    return seeds[at[begins]], at[begins], n


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct seeds of every document, or of every part of a long one."""
    for batch in batches:
        ids, versions = batch.column("id").to_numpy(), batch.column("version").to_numpy()
        for words in places_of(batch.column("text")):
            seeds, at, _ = seed_runs(words)
            pairs = np.unique(np.stack([words.text[at], seeds.view(np.int64)]), axis=1) if len(at) else np.zeros((2, 0), dtype=np.int64)
            if pairs.shape[1]:
                yield pa.record_batch(
                    [pa.array(pairs[1]), pa.array(ids[pairs[0]]), pa.array(versions[pairs[0]])], names=["seed", "id", "version"]
                )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes whose seed is in several documents: pieces of text by seed, or windows by their hash."""
    for batch in batches:
        ids, versions = batch.column("id").to_numpy(), batch.column("version").to_numpy()
        groups, crowded = batch.column("groups"), batch.column("crowded")
        raw = buffers(batch.column("text"))[1]
        for words in places_of(batch.column("text")):
            seeds, at, n = seed_runs(words)
            if not len(at):
                continue
            text = words.text[at]
            light, heavy = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
            for t in np.unique(text):
                lo, hi = np.searchsorted(text, [t, t + 1])
                for found, wanted in ((light, groups), (heavy, crowded)):
                    listed = wanted[int(t)].values
                    if listed is not None and len(listed):
                        found[lo:hi] = np.isin(seeds[lo:hi].view(np.int64), listed.to_numpy(zero_copy_only=False))
            if light.any():
                own, count = at[light], n[light]
                begin, end = words.starts[own], words.ends[own + count + WINDOW - 2]
                pieces = [raw[a:b].tobytes() for a, b in zip(begin, end)]
                yield _records(seeds[light], ids[text[light]], versions[text[light]], words.number[own], count, pieces)
            if heavy.any():
                own = np.repeat(at[heavy], n[heavy]) + _ramp(n[heavy])
                whole, owner = runs_hash(words.hashes, WINDOW)[own], words.text[own]
                for lo in range(0, len(own), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    ones = np.ones(len(own[s]), dtype=np.int64)
                    yield _records(whole[s], ids[owner[s]], versions[owner[s]], words.number[own[s]], ones, None)


def _ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _records(prefix, ids, versions, first, n, pieces) -> pa.RecordBatch:
    columns = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (prefix, ids, versions, first)]
    held = pa.array(pieces, type=pa.binary()) if pieces is not None else pa.nulls(len(n), pa.binary())
    return pa.record_batch(
        [*columns, pa.array(n, type=pa.int32()), held], names=["prefix", "id", "version", "first", "n", "piece"]
    )


def deep_nodes(hashes: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the node at ``depth`` words that it passes, or -1 if it is alone below some node above.

    ``suffixes`` are word numbers with at least ``depth`` words behind them. The tree grows from the root by
    doubling: the children of a node at depth d, at depth 2d, are told apart by the nodes at depth d that their
    next words pass. Suffixes alone in their node are leaves and are dropped on the way.
    """
    node = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    reached = 1
    alive = np.arange(len(suffixes))
    while reached < depth:
        step = min(reached, depth - reached)
        ahead = np.append(node[step:], np.zeros(step, dtype=np.int64))
        pairs = node * (int(node.max(initial=0)) + 1) + ahead
        node = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        reached += step
        shared = np.bincount(node[suffixes[alive]], minlength=1)
        alive = alive[shared[node[suffixes[alive]]] > 1]
        if not len(alive):
            break
    found = np.full(len(suffixes), -1, dtype=np.int64)
    found[alive] = node[suffixes[alive]]
    return found


def _repeats(rows: list[dict]) -> pa.RecordBatch | None:
    """What some whole groups hold of windows that begin in a document with a smaller id."""
    pieces = pa.array([r["piece"] for r in rows], type=pa.large_binary())
    _, offsets, data = pieces.buffers()
    bounds, raw = np.frombuffer(offsets, dtype=np.int64), np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_places(raw, bounds)
    hashes = place_hashes(raw, starts, ends)
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    record = np.repeat(np.arange(len(rows)), n)
    suffixes = np.searchsorted(starts, bounds[:-1])[record] + _ramp(n)
    node = deep_nodes(hashes, suffixes, WINDOW)
    ids = np.array([r["id"] for r in rows], dtype=np.int64)[record]
    least = np.full(int(node.max(initial=-1)) + 2, np.iinfo(np.int64).max, dtype=np.int64)
    np.minimum.at(least, node, ids)
    again = np.flatnonzero((node >= 0) & (ids > least[node]))
    if not len(again):
        return None
    opens = np.ones(len(again), dtype=bool)
    opens[1:] = (np.diff(again) > 1) | (record[again[1:]] != record[again[:-1]])
    begins = np.flatnonzero(opens)
    count = np.diff(np.append(begins, len(again)))
    own = record[again[begins]]
    inside = again[begins] - (np.cumsum(n) - n)[own]
    firsts = np.array([r["first"] for r in rows], dtype=np.int64)[own] + inside
    versions = np.array([r["version"] for r in rows], dtype=np.int64)[own]
    columns = [pa.array(ids[again[begins]]), pa.array(versions), pa.array(firsts), pa.array(count, type=pa.int32())]
    return pa.record_batch(columns, names=["id", "version", "first", "n"])


def _trees(at_once: int) -> Callable:
    """Groups, which come one after another, taken together up to some size; each is whole in one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        words = 0
        for batch in batches:
            for row in batch.to_pylist():
                if words >= at_once and row["prefix"] != held[-1]["prefix"]:
                    if (found := _repeats(held)) is not None:
                        yield found
                    held, words = [], 0
                held.append(row)
                words += row["n"] + WINDOW - 1
        if held and (found := _repeats(held)) is not None:
            yield found

    return run


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + CHUNK_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text without the words that its repeats cover."""
    for batch in batches:
        found = []
        for text, repeats in zip(batch.column("text").to_pylist(), batch.column("repeats").to_pylist()):
            kept, seen, removed = [], 0, 0
            changes: dict[int, int] = {}
            for x in repeats or []:
                changes[x["first"]] = changes.get(x["first"], 0) + 1
                end = x["first"] + x["n"] + WINDOW - 1
                changes[end] = changes.get(end, 0) - 1
            edges = np.array(sorted(changes), dtype=np.int64)
            covered = np.cumsum([changes[e] for e in edges.tolist()]) > 0
            for words in _pieces(text):
                if len(edges):
                    where = np.searchsorted(edges, np.arange(seen, seen + len(words)), side="right")
                    stays = ~np.append(False, covered)[where]
                    removed += len(words) - int(stays.sum())
                    kept.append(b" ".join(compress(words, stays.tolist())))
                else:
                    kept.append(b" ".join(words))
                seen += len(words)
            found.append((seen, removed, b" ".join(k for k in kept if k)))
        columns = [pa.array([f[k] for f in found], type=pa.int64()) for k in (0, 1)]
        text = pa.array([f[2] for f in found], type=pa.binary()).view(pa.string())
        yield pa.record_batch([batch.column("id"), *columns, text], names=["id", "n_words", "n_removed", "kept"])


def repeated_windows(texts: DataFrame) -> DataFrame:
    """``(id, version, first, n)``: the windows of ``texts`` (id, version, text) that also begin in a text with a
    smaller id, ``n`` neighbouring ones from word ``first`` on (from 0). ``version`` tells rows of one id apart; rows
    equal in both are taken as one text, and its windows may be listed more than once."""
    seeds = materialise(texts.mapInArrow(_seeds, _SEEDS), "repeats-seeds")
    shared = seeds.groupBy("seed").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("places"))
    shared = shared.filter("a < b").select("seed", (F.col("places") > GROUP).alias("many"))
    marks = seeds.join(shared, "seed").groupBy("id", "version")
    marks = marks.agg(
        F.collect_set(F.when(~F.col("many"), F.col("seed"))).alias("groups"),
        F.collect_set(F.when(F.col("many"), F.col("seed"))).alias("crowded"),
    )
    marked = texts.join(marks, ["id", "version"]).select("id", "version", "text", "groups", "crowded")
    suffixes = materialise(marked.mapInArrow(_suffixes, _SUFFIXES), "repeats-suffixes")

    grouped = suffixes.filter("piece is not null").repartition("prefix").sortWithinPartitions("prefix")
    in_trees = grouped.mapInArrow(_trees(WORDS_AT_ONCE), _REPEATS)
    crowded = suffixes.filter("piece is null").select("prefix", "id", "version", "first", "n")
    nodes = crowded.groupBy("prefix").agg(F.min("id").alias("least"))
    in_nodes = crowded.join(nodes, "prefix").filter("id > least").select("id", "version", "first", "n")
    return in_trees.union(in_nodes)


def remove_repeats(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` for every row: its words, unchanged, without those that a window of
    ``WINDOW`` words covers whose words also begin in a document with a smaller id; kept words are joined by a space.

    Windows are judged on the input: what goes elsewhere doesn't matter. A word is a run of characters outside
    \\x20 and \\x09-\\x0D. Null text is empty, and a text shorter than a window stays as it is. A row without an id
    is compared with nothing and stays. Rows with the same id don't remove each other's words; rows equal in id
    and text are treated alike. A passage that repeats inside one document only stays. Texts of any length are taken
    whole, a megabyte at a time. An empty table gives an empty result, and other columns are not looked at.
    """
    prepare(docs.sparkSession)
    rows = docs.select(doc_id.cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    named = rows.filter("id is not null")
    found = materialise(repeated_windows(named), "repeats-windows")
    repeats = found.groupBy("id", "version").agg(F.collect_list(F.struct("first", "n")).alias("repeats"))
    with_id = named.join(repeats, ["id", "version"], "left").select("id", "text", "repeats")
    without = rows.filter("id is null").select("id", "text", F.lit(None).cast(with_id.schema["repeats"].dataType).alias("repeats"))
    both = with_id.union(without).withColumn("text", F.col("text").cast("binary"))
    return both.mapInArrow(_keep, _KEPT)
