"""Words and word shingles of Arrow text columns as 64-bit hashes, computed for many texts at once.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, with A-Z lower-cased. Two words are taken
as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is taken whole.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """The words of the texts ``first`` to ``last`` (exclusive) of a batch."""

    first: int
    last: int
    hashes: np.ndarray  # uint64, one per word
    bounds: np.ndarray  # words of text i are hashes[bounds[i]:bounds[i + 1]]

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than there are texts) and UTF-8 bytes; null counts as empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bounds, raw


def spans(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most ``limit`` bytes, or of one text."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class _Powers:
    """Powers of the hash base and of its inverse, as long as the longest chunk so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            self.up = np.full(size, _BASE, dtype=np.uint64).cumprod()
            self.down = np.full(size, _BASE_INVERSE, dtype=np.uint64).cumprod()
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_places(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts between ``cuts`` begin and end."""
    space = (data == 32) | (data - np.uint8(9) < 5)
    opens = np.ones(len(data), dtype=bool)
    opens[1:] = space[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    opens[inner] = True
    closes = np.ones(len(data), dtype=bool)
    closes[:-1] = space[1:]
    closes[inner - 1] = True
    return np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1


def place_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes of every place."""
    up, down = _POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    wide = data.astype(np.uint64)
    wide += np.uint64(1)
    wide *= up
    np.cumsum(wide, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words_of(column: pa.Array) -> Iterator[Words]:
    """The words of a text column, chunk by chunk."""
    bounds, raw = buffers(column)
    for first, last in spans(bounds):
        low = bounds[first]
        cuts = bounds[first : last + 1] - low
        data = LOWER[raw[low : bounds[last]]]
        if not len(data):
            yield Words(first, last, np.zeros(0, dtype=np.uint64), np.zeros(last - first + 1, dtype=np.int64))
            continue
        starts, ends = word_places(data, cuts)
        hashes = place_hashes(data, starts, ends)
        yield Words(first, last, hashes, np.searchsorted(starts, cuts))


def shingles_at(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` words; fewer words make one window of all, none makes none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    found = hashes[: len(hashes) - size + 1].copy()
    for k in range(1, size):
        found = found * _BASE + hashes[k : len(hashes) - size + 1 + k]
    return mix(found + np.uint64(size))


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """For every text of a chunk the ascending distinct shingle hashes."""
    all_at = shingles_at(words.hashes, size)
    for i in range(words.last - words.first):
        start, end = words.bounds[i], words.bounds[i + 1]
        if end - start >= size:
            yield np.unique(all_at[start : end - size + 1])
        else:
            yield shingles_at(words.hashes[start:end], size)
