"""Passages of benchmark items in documents, by SimHash fingerprints of item-sized windows and an exact check.

An item of n words is looked for in the windows of n words of every document. Two windows are as similar as
the multisets of their word shingles: the n-th occurrence of a shingle is a feature, so a window is a set of
features, and a fingerprint holds for every bit the sign of the sum of its features' random signs. If two sets
reach the similarity, the angle between them is bounded by their sizes alone, wherever the differing words lie,
and so is the chance that a bit differs. The radius follows from that: fewer than one in a billion of the windows
that are similar enough have a fingerprint beyond it.

Fingerprints are cut into blocks. The blocks' allowances add up to the radius in such a way that a fingerprint
within the radius must be within the allowance of one block at least (pigeonhole), so looking up the near
values of every block finds all of them. Items found so are compared exactly, by weighted shingle similarity.

Windows that hold too few shingles of items of their size to be similar to any can't be found; their
fingerprints are not made. That is the whole of the sieve: it looks at the hash of every shingle of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ROW, giving_back, leave, settle, with_row_numbers
from corpusloom.llm.words import Words, mix, shingles_at, words_of

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE = 5
PERCENT = 80
#: Bits of a fingerprint, and of one of its blocks.
BITS = 256
BLOCK_BITS = 16
#: Chance that the fingerprint of a window that is similar enough lies beyond the radius.
MISSED = 1e-9
#: Bytes of item text that are compared with all documents in one pass.
PASS_BYTES = 16 << 20
#: Bits of the table that tells most shingles from those of items.
_FILTER = 1 << 22
#: Windows whose fingerprints are made together, features whose signs are, and cells of a comparison.
_RUN, _PIECE, _CELLS = 4096, 1 << 15, 1 << 21

_FOUND = "doc_id long, item_id long, start_word int, n_words int, similarity double, distance int"
_SET_BITS = np.array([x.bit_count() for x in range(1 << BLOCK_BITS)], dtype=np.uint8)
_NEXT = np.uint64(0xD1B54A32D192ED03)


def least_shared(one: int, other: int) -> int:
    """Features that sets of these sizes have in common at least, if they are similar enough."""
    return ceil(PERCENT * (one + other) / (100 + PERCENT))


@cache
def radius(one: int, other: int) -> int:
    """Bits in which the fingerprints of similar sets of these sizes differ at most, but for ``MISSED`` of them."""
    shared = least_shared(one, other)
    chance = acos(min(1.0, shared / sqrt(one * other))) / pi
    left, bits = 1.0, -1
    while left > MISSED and bits < BITS:
        bits += 1
        left -= comb(BITS, bits) * chance**bits * (1 - chance) ** (BITS - bits)
    return bits


def allowances(most: int) -> list[int]:
    """Differing bits that are looked up in every block. One more in each would be more than ``most`` in all."""
    blocks = BITS // BLOCK_BITS
    each, more = divmod(most + 1, blocks)
    return [each - 1 + (b < more) for b in range(blocks)]


def features_of(shingles: np.ndarray) -> np.ndarray:
    """The ascending features of a window: each shingle with the number of its occurrence."""
    ordered = np.sort(shingles)
    at = np.arange(len(ordered))
    first = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], at, 0))
    return np.sort(mix(ordered + (at - first).astype(np.uint64) * _NEXT))


def _signs(features: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` zeros and ones for every feature."""
    lanes = np.stack([mix(features + np.uint64(k + 1)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(lanes.view(np.uint8), axis=1)


def _sums(features: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(features), _PIECE):
        total += _signs(features[at : at + _PIECE]).sum(axis=0, dtype=np.int64)
    return total


def _as_blocks(set_bits: np.ndarray) -> np.ndarray:
    return np.packbits(set_bits, axis=-1).view(np.uint16)


def print_of(features: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of features, as the values of its blocks."""
    return _as_blocks(2 * _sums(features) > len(features))


def window_prints(shingles: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """The fingerprints of the windows of ``span`` shingles at the ascending ``starts``."""
    prints = np.zeros((len(starts), BITS // BLOCK_BITS), dtype=np.uint16)
    breaks = np.flatnonzero(np.diff(starts) != 1) + 1
    for run in np.split(np.arange(len(starts)), breaks):
        for at in range(0, len(run), _RUN):
            part = run[at : at + _RUN]
            first, n = int(starts[part[0]]), len(part)
            held = shingles[first : first + span + n - 1]
            once = mix(held)
            sums = np.zeros((n, BITS), dtype=np.int64)
            sums[1:] = np.cumsum(_signs(once[span:]).astype(np.int64) - _signs(once[: n - 1]), axis=0)
            prints[part] = _as_blocks(2 * (sums + _sums(once[:span])) > span)
            for i in np.flatnonzero(_with_repeats(held, n, span)).tolist():
                prints[part[i]] = print_of(features_of(held[i : i + span]))
    return prints


def _with_repeats(held: np.ndarray, n: int, span: int) -> np.ndarray:
    """Which of the ``n`` windows hold a shingle more than once."""
    order = np.argsort(held, kind="stable")
    before = np.full(len(held), -1)
    same = held[order[1:]] == held[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    latest = np.maximum.accumulate(before)
    return latest[span - 1 :] >= np.arange(n)


class Group:
    """The items of one number of words: features, fingerprints, and a table of block values for every block."""

    def __init__(self, n_words: int, ids: list[int], words: list[np.ndarray]) -> None:
        self.n_words, self.ids = n_words, ids
        self.shingle = min(SHINGLE, n_words)
        self.features = [features_of(shingles_at(w, SHINGLE)) for w in words]
        self.size = n_words - self.shingle + 1
        self.prints = np.stack([print_of(x) for x in self.features])
        self.tables = []
        for values in self.prints.T:
            members = np.argsort(values, kind="stable")
            keys, first = np.unique(values[members], return_index=True)
            self.tables.append((keys, np.r_[first, len(members)], members))

    def near(self, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of a fingerprint and an item that differ in at most ``most`` bits: places of both, and the bits."""
        found = []
        for b, allowed in enumerate(allowances(most)):
            if allowed >= 0:
                keys, first, members = self.tables[b]
                step = max(1, _CELLS // len(keys))
                for low in range(0, len(prints), step):
                    window, key = np.nonzero(_SET_BITS[prints[low : low + step, b, None] ^ keys] <= allowed)
                    counts = first[key + 1] - first[key]
                    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    item = members[np.repeat(first[key], counts) + place]
                    found.append((np.repeat(window, counts) + low) * len(self.ids) + item)
        window, item = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        bits = np.concatenate(
            [np.zeros(0, dtype=np.int64)]
            + [
                _SET_BITS[prints[window[at : at + _PIECE]] ^ self.prints[item[at : at + _PIECE]]].sum(axis=1, dtype=np.int64)
                for at in range(0, len(window), _PIECE)
            ]
        )
        close = bits <= most
        return window[close], item[close], bits[close]


@dataclass
class Items:
    """Items of one pass: groups by number of words, and the groups that a shingle occurs in."""

    groups: list[Group]
    shingles: np.ndarray  # ascending, of all items
    first: np.ndarray  # groups of shingle i are owners[first[i]:first[i + 1]]
    owners: np.ndarray
    sizes: list[int]  # of shingles: five words, or all of a shorter item
    sieve: np.ndarray


def index_items(rows: list[tuple[int, np.ndarray]]) -> Items:
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item_id, words in rows:
        by_size.setdefault(len(words), []).append((item_id, words))
    groups, shingles, owners = [], [], []
    for g, (n_words, members) in enumerate(sorted(by_size.items())):
        groups.append(Group(n_words, [x for x, _ in members], [w for _, w in members]))
        own = np.unique(np.concatenate([shingles_at(w, SHINGLE) for _, w in members]))
        shingles.append(own)
        owners.append(np.full(len(own), g, dtype=np.int32))
    merged, of = np.concatenate(shingles), np.concatenate(owners)
    order = np.argsort(merged, kind="stable")
    distinct, first = np.unique(merged[order], return_index=True)
    sieve = np.zeros(_FILTER, dtype=bool)
    sieve[(distinct & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    return Items(groups, distinct, np.r_[first, len(merged)], of[order], sorted({g.shingle for g in groups}), sieve)


def find_in(words: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, float, int]]:
    """The best window for every item that a document holds: (item, start, words, similarity, distance)."""
    shingles_of = {size: shingles_at(words, size) for size in items.sizes if size <= len(words)}
    for size, shingles in shingles_of.items():
        at, shingle = _of_items(shingles, items)
        counts = items.first[shingle + 1] - items.first[shingle]
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner, at = items.owners[np.repeat(items.first[shingle], counts) + place], np.repeat(at, counts)
        order = np.argsort(owner, kind="stable")
        found, first = np.unique(owner[order], return_index=True)
        for g, places in zip(found.tolist(), np.split(at[order], first[1:])):
            if items.groups[g].shingle == size:
                yield from _best_windows(shingles, places, min(items.groups[g].n_words, len(words)), items.groups[g])


def _best_windows(shingles: np.ndarray, places: np.ndarray, reach: int, group: Group) -> Iterator[tuple]:
    """The most similar window of ``reach`` words for every item of the group that has one, the first of equal ones.

    ``places`` are those of shingles of the group's items, ascending.
    """
    span = reach - group.shingle + 1
    needed = least_shared(span, group.size)
    if len(places) < needed:
        return
    starts = np.arange(max(0, int(places[0]) - span + 1), min(int(places[-1]), len(shingles) - span) + 1)
    held = np.searchsorted(places, starts + span) - np.searchsorted(places, starts)
    starts = starts[held >= needed]
    if not len(starts):
        return
    # Windows with the same shingles as often are equal: the first stands for them.
    low, high = int(starts[0]), int(starts[-1]) + span
    sums = np.zeros(high - low + 1, dtype=np.uint64)
    np.cumsum(mix(shingles[low:high]), out=sums[1:])
    _, firsts = np.unique(sums[starts - low + span] - sums[starts - low], return_index=True)
    starts = starts[np.sort(firsts)]
    best: dict[int, tuple[float, int, int]] = {}
    for at in range(0, len(starts), _RUN):
        part = starts[at : at + _RUN]
        window, item, bits = group.near(window_prints(shingles, part, span), radius(span, group.size))
        last = None
        for w, i, distance in zip(window.tolist(), item.tolist(), bits.tolist()):
            if w != last:
                own, last = features_of(shingles[part[w] : part[w] + span]), w
            shared = len(np.intersect1d(own, group.features[i], assume_unique=True))
            alike = shared / (span + group.size - shared)
            if shared >= needed and (i not in best or alike > best[i][0]):
                best[i] = (alike, int(part[w]), distance)
    for i, (alike, start, distance) in sorted(best.items()):
        yield group.ids[i], start, reach, alike, distance


def _finder(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        schema = pa.schema(
            [("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()),
             ("similarity", pa.float64()), ("distance", pa.int32())]
        )
        for batch in batches:
            found = []
            for words in words_of(batch.column(1)):
                if not len(words.hashes):
                    continue
                for i in _texts_with_hits(words, items):
                    doc_id = batch.column(0)[words.first + i].as_py()
                    found += [(doc_id, *x) for x in find_in(words.of(i), items)]
            if found:
                yield pa.record_batch([pa.array(x, type=f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    return run


def _of_items(shingles: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles of items stand, and which they are."""
    at = np.flatnonzero(items.sieve[(shingles & np.uint64(_FILTER - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(items.shingles, shingles[at]), len(items.shingles) - 1)
    same = items.shingles[place] == shingles[at]
    return at[same], place[same]


def _texts_with_hits(words: Words, items: Items) -> list[int]:
    """Texts of a chunk that have a shingle of an item."""
    found: set[int] = set()
    for size in items.sizes:
        if size <= len(words.hashes):
            hits, _ = _of_items(shingles_at(words.hashes, size), items)
            owner = np.searchsorted(words.bounds, hits, side="right") - 1
            found.update(owner[hits + size <= words.bounds[owner + 1]].tolist())
    return sorted(found)


def _passes(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items, a bounded number of bytes at a time."""
    rows, size = [], 0
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    items = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    for row in items.orderBy("item_id", "text").toLocalIterator():
        words = next(words_of(pa.array([row.text]))).hashes
        if len(words):
            rows.append((row.item_id, words))
            size += len(row.text.encode())
        if size >= PASS_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, similarity, distance)``: the best window of every document
    for every benchmark item that it holds.

    Texts are compared by their words, whole; a document shorter than an item is one window. An item of fewer
    than five words is one shingle. Null and blank
    texts and items, and items without an id, give nothing. Repeated items are looked for once, repeated
    documents give a row each. The benchmark is the query set: its items go to the workers ``PASS_BYTES`` at a
    time, and every pass reads all documents. Other columns are not looked at. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = spark.createDataFrame([], _FOUND)
    for items in _passes(benchmark, item_id, "text"):
        index = spark.sparkContext.broadcast(index_items(items))
        found = found.union(rows.mapInArrow(giving_back(_finder(index)), _FOUND))
    return found


def drop_leaky(docs: DataFrame, benchmark: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Every row is judged by its own text, whether its id is repeated or null, and every item counts, whether it has
    an id or not. ``stored`` is that of ``with_row_numbers``.
    """
    rows = with_row_numbers(docs, stored)
    # Items are told apart by their texts here, so that those without an id are looked for too.
    items = benchmark.select(F.xxhash64("text").alias("item_id"), "text")
    found = find_leaks(rows, items, doc_id=ROW).select(F.col("doc_id").alias(ROW)).distinct()
    return leave(rows, settle(docs.sparkSession, "leaky-rows", lambda: found)).select(*docs.columns)
