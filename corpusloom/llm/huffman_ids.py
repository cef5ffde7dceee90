"""Token ids of documents in a compact file format: canonical length-limited Huffman codes in independent blocks.

A dataset is a folder of two Parquet tables. ``codes`` has the code length of every id that occurs; the
canonical code follows from the lengths. ``blocks`` has rows of whole documents in ascending order: their
ids, the number of token ids of each, the number of token ids of all documents before the block, the
coded bits, and the bit offset of every 256th token id. A block is decoded without any other, and inside
it the pieces between two offsets are decoded side by side with one table lookup per token id.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import giving_back, materialise
from corpusloom.llm.words import LOWER, buffers, place_hashes, spans, word_places
from corpusloom.session import drop_path, new_path

#: Token ids of a block, unless one document alone has more.
BLOCK_IDS = 1 << 19
#: Token ids between two stored bit offsets.
STRIDE = 256
#: Longest code word; raised only if a vocabulary has more ids than there are such words.
CODE_BITS = 16
#: Words whose ids a worker remembers, twice: the latest, and those before them.
REMEMBERED = 1_000_000

_TOKENS = "part int, doc_id long, before long, n long, ids binary"
_BLOCKS = "part int, start long, doc_ids array<long>, counts array<int>, bits binary, offsets binary"


class _Known:
    """Ids of words by the hash of the word: ascending hashes, and where the ids stand in one long array."""

    def __init__(self, dtype: np.dtype) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts = self.counts = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=dtype)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, flat])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.counts = np.concatenate([self.counts, counts])[order]

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words has, and the ids one after the other."""
        counts = self.counts[at]
        ends = np.cumsum(counts)
        shift = np.repeat(self.starts[at] - (ends - counts), counts)
        return counts, self.flat[shift + np.arange(len(shift))]


def _white_space_is_dropped(spec: dict) -> bool:
    """Whether the tokenizer splits at white space and drops it, so that words can be encoded one by one."""
    return any(
        step.get("type") == "Split" and step.get("behavior") == "Removed" and step.get("invert")
        or step.get("type") in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer")
        for step in _steps(spec.get("pre_tokenizer"), "pretokenizers")
    )


def _steps(part: dict | None, inner: str) -> list[dict]:
    return [] if not part else part.get(inner) or [part]


class _Tokenizer:
    """The ids of texts, by way of their words: the tokenizer drops white space and joins nothing across it.

    Every word is given to the library once, as long as it is among the latest words; words are told apart by
    64-bit hashes. If the tokenizer lower-cases all, so is the word, unless it holds an added token in any case:
    these are matched with case. And if it parts letters from other
    signs, a full stop or comma after an ASCII letter that ends a word is a word of its own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = _white_space_is_dropped(spec)
        lowers = any(x.get("type") == "Lowercase" for x in _steps(spec.get("normalizer"), "normalizers"))
        patterns = [x.get("pattern", {}).get("Regex", "") for x in _steps(spec.get("pre_tokenizer"), "pretokenizers")]
        self.folds = lowers and any(x.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") for x in patterns)
        self.added = [x["content"].encode().lower() for x in spec.get("added_tokens") or [] if x.get("content")]
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.latest, self.older = _Known(self.dtype), _Known(self.dtype)

    def _library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in ids], dtype=np.int64)
        return counts, np.fromiter(chain.from_iterable(ids), dtype=self.dtype, count=int(counts.sum()))

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``cuts``: how many each has, and all one after the other."""
        if not self.by_words:
            raw = data.tobytes()
            return self._library([raw[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())])
        given = data
        if self.folds:
            data = LOWER[data]
        starts, ends = word_places(data, cuts)
        if self.folds:
            self._unfold(data, given, starts, ends)
        if self.folds and len(starts):
            last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
            part = ((last == 44) | (last == 46)) & (ends - starts > 1) & (before >= 97) & (before <= 122)
            at = ends[part] - 1
            starts = np.sort(np.concatenate([starts, at]))
            ends = np.sort(np.concatenate([ends, at]))
        hashes = place_hashes(data, starts, ends)
        distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(distinct, data, starts[first], ends[first])
        counts, flat = self.latest.gather(self.latest.find(distinct)[word])
        bounds = np.searchsorted(starts, cuts)
        whole = np.r_[0, np.cumsum(counts)][bounds]
        if len(self.latest.hashes) > REMEMBERED:
            self.older, self.latest = self.latest, _Known(self.dtype)
        return np.diff(whole), flat

    def _unfold(self, data: np.ndarray, given: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Give words of ``data`` that hold an added token in any case the bytes that they had."""
        lowered = data.tobytes()
        for token in self.added:
            at = lowered.find(token)
            while at >= 0:
                first = max(0, int(np.searchsorted(starts, at, side="right")) - 1)
                last = max(first, int(np.searchsorted(starts, at + len(token) - 1, side="right")) - 1)
                if first < len(starts):
                    data[starts[first] : ends[last]] = given[starts[first] : ends[last]]
                at = lowered.find(token, at + 1)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """See to it that the latest words hold all of ``hashes``."""
        missing = np.flatnonzero(self.latest.find(hashes) < 0)
        if not len(missing):
            return
        old = self.older.find(hashes[missing])
        again = missing[old >= 0]
        if len(again):
            self.latest.add(hashes[again], *self.older.gather(old[old >= 0]))
        fresh = missing[old < 0]
        if len(fresh):
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist())]
            self.latest.add(hashes[fresh], *self._library(words))


_LOADED: dict[str, _Tokenizer] = {}


def tokenizer_at(path: str) -> _Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = _Tokenizer(path)
    return _LOADED[path]


def _tokeniser(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        tokenizer = tokenizer_at(path)
        for batch in batches:
            bounds, raw = buffers(batch.column(1))
            for first, last in spans(bounds):
                cuts = bounds[first : last + 1] - bounds[first]
                counts, flat = tokenizer.encode(raw[bounds[first] : bounds[last]], cuts)
                flat = np.insert(flat, np.cumsum(counts), end_id)
                counts = counts + 1
                ids = as_binary(flat, counts)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(counts), part, dtype=np.int32)),
                        batch.column(0).slice(first, last - first),
                        pa.array(starts),
                        pa.array(counts),
                        ids,
                    ],
                    names=["part", "doc_id", "before", "n", "ids"],
                )

    return run


def as_binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` values each as binaries."""
    bounds = np.r_[0, np.cumsum(counts)] * values.itemsize
    large = pa.Array.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(values)]
    )
    return large.cast(pa.binary())


def _counter(dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, dtype=np.int64)
        parts: dict[int, int] = {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            sizes = batch.column(1).to_numpy()
            for part in np.unique(own):
                parts[int(part)] = parts.get(int(part), 0) + int(sizes[own == part].sum())
            bounds, raw = buffers_of_binary(batch.column(2))
            ids = np.frombuffer(raw[bounds[0] : bounds[-1]].tobytes(), dtype=dtype)
            fresh = np.bincount(ids, minlength=len(counts))
            fresh[: len(counts)] += counts
            counts = fresh
        used = np.flatnonzero(counts)
        yield pa.record_batch(
            [
                pa.array(np.r_[np.zeros(len(used)), np.ones(len(parts))].astype(np.int32)),
                pa.array(np.r_[used, list(parts)].astype(np.int64)),
                pa.array(np.r_[counts[used], list(parts.values())].astype(np.int64)),
            ],
            names=["kind", "key", "n"],
        )

    return run


def buffers_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    large = column.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    return bounds, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with words of at most ``limit`` bits, by merging packages.

    ``counts`` are positive. Equal counts are ordered by position, so that reruns agree.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if 1 << limit < n:
        raise ValueError(f"{n} symbols do not fit into words of {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    is_leaf, merged = [], weights
    for _ in range(limit):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1) if is_leaf else np.zeros(0)
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        is_leaf.append(at < n)
        merged = both[at]
    lengths, taken = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        leaves = int(leaf[:taken].sum())
        lengths[:leaves] += 1
        taken = 2 * (taken - leaves)
    found = np.empty(n, dtype=np.int64)
    found[order] = lengths
    return found


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words, by length and then by symbol; ``lengths`` is by ascending symbol."""
    order = np.argsort(lengths, kind="stable")
    codes, code, before = np.zeros(len(lengths), dtype=np.int64), 0, 0
    for at in order:
        code <<= int(lengths[at]) - before
        before = int(lengths[at])
        codes[at] = code
        code += 1
    return codes


class Code:
    """Tables for coding and decoding, from the symbols that occur and the lengths of their words."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        self.width = int(lengths.max()) if len(lengths) else 1
        codes = canonical_codes(lengths)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.lengths = np.zeros(size, dtype=np.int64)
        self.codes = np.zeros(size, dtype=np.uint64)
        self.lengths[symbols] = lengths
        self.codes[symbols] = codes.astype(np.uint64)
        # Words in canonical order fill the table from its start, each 2 ** (width - length) places.
        order = np.argsort(lengths, kind="stable")
        places = 1 << (self.width - lengths[order])
        filled = np.repeat(symbols[order], places)
        self.symbol_at = np.zeros(1 << self.width, dtype=np.uint32)
        self.length_at = np.ones(1 << self.width, dtype=np.int64)
        self.symbol_at[: len(filled)] = filled
        self.length_at[: len(filled)] = np.repeat(lengths[order], places)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, high bit first, and the offset of every ``STRIDE``-th id."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(ends) else 0
        # Every word lies in one or two neighbouring 32-bit cells; no two words share a bit, so sums are unions.
        cell = starts >> 5
        wide = self.codes[ids] << (64 - (starts & 31) - lengths).astype(np.uint64)
        cells = (total >> 5) + 2
        high = np.bincount(cell, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=cells)
        low = np.bincount(cell + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=cells)
        whole = (high[:cells] + low[:cells]).astype(np.uint64).astype(">u4").tobytes()
        return whole[: (total + 7) >> 3], starts[::STRIDE].astype("<u4")

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        padded = np.frombuffer(bits + bytes(STRIDE * 4 + 8), dtype=np.uint8).astype(np.uint32)
        window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        at = offsets.astype(np.int64)
        last = len(window) - 1
        out = np.empty((STRIDE, len(at)), dtype=np.uint32)
        mask = np.uint32((1 << self.width) - 1)
        for k in range(min(STRIDE, n)):
            shift = (32 - self.width - (at & 7)).astype(np.uint32)
            found = (window[np.minimum(at >> 3, last)] >> shift) & mask
            out[k] = self.symbol_at[found]
            at += self.length_at[found]
        return out.T.reshape(-1)[:n]


def _encoder(dtype: str, code, starts) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, offset_of = code.value, starts.value
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            part, first = held[0][0], held[0][2]
            ids = np.frombuffer(b"".join(x[4] for x in held), dtype=dtype)
            bits, offsets = tables.encode(ids)
            return pa.record_batch(
                [
                    pa.array([part], type=pa.int32()),
                    pa.array([offset_of[part] + first], type=pa.int64()),
                    pa.array([[x[1] for x in held]], type=pa.list_(pa.int64())),
                    pa.array([[x[3] for x in held]], type=pa.list_(pa.int32())),
                    pa.array([bits], type=pa.binary()),
                    pa.array([offsets.tobytes()], type=pa.binary()),
                ],
                names=["part", "start", "doc_ids", "counts", "bits", "offsets"],
            )

        n = 0
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                follows = not held or (row[0] == held[-1][0] and row[2] == held[-1][2] + held[-1][3])
                if held and (n + row[3] > BLOCK_IDS or not follows):
                    yield block()
                    held, n = [], 0
                held.append(row)
                n += row[3]
        if held:
            yield block()

    return run


def _decoder(code) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = code.value
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], dtype=np.int64)
                offsets = np.frombuffer(row["offsets"], dtype="<u4")
                ids = tables.decode(row["bits"], offsets, int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                yield pa.record_batch(
                    [
                        pa.array(row["doc_ids"], type=pa.int64()),
                        pa.array(row["start"] + ends - counts),
                        pa.array(counts),
                        as_binary(ids, counts),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Tokenize whole texts and write them as a dataset at ``path``, in ascending order of ``doc_id``.

    Every document ends with ``end_id``; a null or empty text is that id alone. Null ids come first. Rows
    with one id are all kept, next to each other, in an order that depends on their texts only. ``path``
    is a folder that does not exist yet, ``tokenizer`` a file that every executor has. An empty table
    gives an empty dataset. Other columns are not looked at.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")
    tokens_path = new_path(spark, "token-ids")
    tokens = materialise(ordered.mapInArrow(giving_back(_tokeniser(tokenizer, end_id)), _TOKENS), "token-ids", tokens_path)

    dtype = tokenizer_at(tokenizer).dtype.str
    counted = tokens.select("part", "n", "ids").mapInArrow(giving_back(_counter(dtype)), "kind int, key long, n long")
    totals = counted.groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()  # a row per id and part
    kind, key, n = (totals[c].to_numpy() for c in ("kind", "key", "n"))
    order = np.argsort(key[kind == 0])
    symbols, counts = key[kind == 0][order], n[kind == 0][order]
    limit = max(CODE_BITS, int(len(symbols)).bit_length())
    lengths = code_lengths(counts, limit)
    sizes = sorted(zip(key[kind == 1].tolist(), n[kind == 1].tolist()))
    offsets = np.cumsum([0] + [size for _, size in sizes])
    starts = {part: int(at) for (part, _), at in zip(sizes, offsets)}

    share = spark.sparkContext.broadcast
    encoder = _encoder(dtype, share(Code(symbols, lengths)), share(starts))
    tokens.mapInArrow(giving_back(encoder), _BLOCKS).write.partitionBy("part").parquet(f"{path}/blocks")
    drop_path(spark, tokens_path)
    code_rows = list(zip(symbols.tolist(), lengths.tolist()))
    spark.createDataFrame(code_rows, "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of a dataset: ``start`` token ids come before the document, and
    ``ids`` are its own as little-endian unsigned 32-bit integers."""
    table = spark.read.schema("id long, bits int").parquet(f"{path}/codes").orderBy("id").toArrow()
    code = Code(table["id"].to_numpy(), table["bits"].to_numpy().astype(np.int64))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").select("start", "doc_ids", "counts", "bits", "offsets")
    schema = "doc_id long, start long, n_tokens long, ids binary"
    return blocks.mapInArrow(giving_back(_decoder(spark.sparkContext.broadcast(code))), schema)
