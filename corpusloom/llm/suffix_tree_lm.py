"""Language-model scores by a probabilistic suffix tree over words.

Tokens are words and one end per text. A state of the tree is a context of up to ``DEPTH`` words. A context
is a candidate if a continuation of it occurs ``LEAST`` times, at any corpus size; it is kept if the
distribution of what follows diverges from that of its suffix by enough: the log-likelihood gained on its
own occurrences exceeds ``GAIN`` per continuation that is stored. A token is scored by the longest kept
context before it. Each state gives the probability

    (count(context, token) + back * P(token | shorter context)) / (count(context) + PRIOR)

where ``back`` is what its stored continuations leave, so probabilities sum to one; at the root stands
the base ``(c + 0.5) / (N + 0.5 * (V + 1))``.

The tree grows with the corpus and stays in tables. Contexts and continuations are both runs of words, told
apart by one hash: what a run adds to the score of a text is one number, its weight as a context (for the token
after it) and what it gains as a continuation. So a text's score is a sum over its runs of up to ``DEPTH + 1``
tokens, which are sent to their numbers. Runs above ``COMMON`` of all tokens, a bounded number, go to all
workers instead.

Runs far outnumber the texts. Spark deals them by hash into parts of about ``PART`` training tokens; what a block
of texts has for a part travels as one row of packed arrays, and meets the rows of the same part from other tables.
The tree grows by length: runs meet their contexts, which are the runs shorter by one; those that occur often enough
ask the parts of their suffixes for the probability there, and are settled with the answers. Counting and scoring
read the texts several times, each time for the runs of one share of the hashes, so that runs never lie on disk all at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BITMAP_BITS, ROW, bitmap_words, giving_back, in_bitmap, materialise, settle, with_row_numbers
from corpusloom.llm.words import Words, mix, words_of
from corpusloom.session import drop_path, new_path

#: Longest context, in words.
DEPTH = 3
#: Least occurrences of a continuation.
LEAST = 2
#: Least share of the training tokens for runs whose numbers every worker has.
COMMON = 1e-6
#: Natural-log likelihood a context must gain per stored continuation.
GAIN = 4.0
#: Weight of the shorter context, in occurrences.
PRIOR = 2.0
#: Tokens that are counted or scored together before they are shuffled.
BLOCK = 1 << 21
#: Hashes that are looked up together.
SLICE = 1 << 17
#: Training tokens to a part of the hashes.
PART = 1 << 21
#: Shares of the hashes of contexts, each counted and settled by itself.
COUNT_SHARES = 2
#: Shares of the hashes of runs, each scored by itself.
SHARES = 4
#: Stands for the end of a text among the word hashes.
END = np.uint64(0x5BF03635F0935A5D)

#: Runs of a block whose context is in a part: context, last token and count.
_COUNTS = "part int, context binary, token binary, n binary"
#: Runs that occur often enough, of contexts in a part, and what they ask of the parts of their suffixes (``asked``).
_FOUND = "part int, asked int, suffix binary, gram binary, n binary, owner binary, context binary, occurs binary, rest binary"
_ANSWERS = "part int, asked int, p binary"
#: Runs of a part with their suffixes and probabilities (``level``), or what runs of a part and share add.
_SETTLED = "level boolean, part int, key binary, suffix binary, n binary, c binary, value binary"
_LOOKUPS = f"part int, block long, owner binary, key binary, {ROW} binary, n_tokens binary, known binary, base binary, gain binary"
_SUMS = f"block long, owner binary, {ROW} binary, n_tokens binary, known binary, base binary, gain binary"
_TEXTS = f"{ROW} long, n_tokens long, known double, base double, gain double"
_NUMBERS = "key long, c long, value double, n long"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts with an end after each, and the place of every token in its text."""
    lengths = np.diff(words.bounds)
    tokens = np.insert(words.hashes, words.bounds[1:], END)
    place = np.arange(len(tokens)) - np.repeat(np.r_[0, np.cumsum(lengths + 1)[:-1]], lengths + 1)
    return tokens, place


def _longer(context: np.ndarray, token: np.ndarray, length: int) -> np.ndarray:
    """The hashes of runs of ``length`` by their contexts (0 for none) and last tokens."""
    return mix(context * _STEP + token + np.uint64(length))


def _runs(tokens: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For lengths 1 to ``DEPTH + 1``: tokens that end a run of so many in their text, and for every token the
    hash of the run that ends there."""
    key = np.zeros(len(tokens), dtype=np.uint64)
    for length in range(1, DEPTH + 2):
        key = _longer(np.r_[np.uint64(0), key[:-1]][: len(key)], tokens, length)
        yield length, np.flatnonzero(place >= length - 1), key


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return arrays[0] if len(arrays) == 1 else np.concatenate(arrays)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, their places and the numbers (the second column, if there is one) of a few texts at a time."""
    for batch in batches:
        rows = batch.column(1).to_numpy() if batch.num_columns > 1 else np.zeros(batch.num_rows, dtype=np.int64)
        for words in words_of(batch.column(0)):
            yield (*_with_ends(words), rows[words.first : words.last])


def _blocks(pieces: Iterator[tuple[int, tuple]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of pieces that have ``BLOCK`` tokens together, joined; a piece is its number of tokens and its arrays."""
    gathered: list[tuple] = []
    size = 0
    for tokens, arrays in pieces:
        gathered.append(arrays)
        size += tokens
        if size >= BLOCK:
            yield tuple(map(_joined, zip(*gathered)))
            gathered, size = [], 0
    if gathered:
        yield tuple(map(_joined, zip(*gathered)))


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each value of an array begins that has equal ones next to each other."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])


def _order(keys: np.ndarray) -> np.ndarray:
    """``argsort`` of hashes: their first bits are sorted with the places in the last ones, which mostly suffices."""
    low = (np.uint64(1) << np.uint64(max(1, len(keys)).bit_length())) - np.uint64(1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ordered = keys[order]
    return np.argsort(keys) if (ordered[1:] < ordered[:-1]).any() else order


class _Index:
    """Ascending hashes, found by where those with the same first bits begin."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        if len(keys):
            span = int(keys[-1]) - int(keys[0]) + 1
            self.shift = np.uint64(max(0, span.bit_length() - len(keys).bit_length()))
            buckets = (span >> int(self.shift)) + 1
            self.starts = np.r_[0, np.cumsum(np.bincount(self._bucket(keys), minlength=buckets))]

    def _bucket(self, values: np.ndarray) -> np.ndarray:
        return ((values - self.keys[0]) >> self.shift).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands, or -1; in slices, so that little memory is held next to the result."""
        found = np.full(len(values), -1)
        for first in range(0, len(values) if len(self.keys) else 0, SLICE):
            self._find_into(found[first : first + SLICE], values[first : first + SLICE])
        return found

    def _find_into(self, found: np.ndarray, values: np.ndarray) -> None:
        live = np.flatnonzero((values >= self.keys[0]) & (values <= self.keys[-1]))
        values = values[live]
        bucket = self._bucket(values)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        while len(live):
            go = np.flatnonzero(at < end)
            live, values, at, end = live[go], values[go], at[go], end[go]
            same = self.keys[at] == values
            found[live[same]] = at[same]
            go = np.flatnonzero(~same)
            live, values, at, end = live[go], values[go], at[go] + 1, end[go]


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """For every number in ``to`` what belongs to it, as bytes."""
    order = np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")
    to, columns = to[order], [x[order] for x in columns]
    starts = _starts(to)
    for first, last in zip(starts, np.r_[starts[1:], len(to)]):
        yield int(to[first]), [x[first:last].tobytes() for x in columns]


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _rows_of(schema: str, rows: list[dict]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(name, _TYPES[kind]) for name, kind in fields]))


def _table_of(schema: str, rows: list[dict]) -> pa.Table:
    return pa.Table.from_batches([_rows_of(schema, rows)])


def _unpacked(table: pa.Table, **kinds: type) -> list[np.ndarray]:
    """Packed columns of all rows, one array each."""
    return [np.frombuffer(b"".join(table[name].drop_null().to_pylist()), dtype=kind) for name, kind in kinds.items()]


def _single_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (tokens,) in _blocks((len(tokens), (tokens,)) for tokens, _, _ in _pieces(batches)):
        values, counts = np.unique(_longer(np.uint64(0), tokens, 1), return_counts=True)
        yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts)], names=["key", "n"])


def _grams(tokens: np.ndarray, place: np.ndarray, length: int, share: int) -> tuple[np.ndarray, ...]:
    """Contexts, last tokens and hashes of the runs of ``length`` whose context is in ``share``."""
    for reached, _, key in _runs(tokens, place):
        if reached == length - 1:
            break
    in_share = key[:-1] % np.uint64(COUNT_SHARES) == share
    at = np.flatnonzero((place[1:] >= length - 1) & in_share) + 1
    context, token = key[at - 1], tokens[at]
    return context, token, _longer(context, token, length)


def _gram_counts(length: int, share: int, parts: int) -> Callable:
    """Counts of a block's runs of ``length`` whose context is in ``share``, dealt by their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((len(tokens), _grams(tokens, place, length, share)) for tokens, place, _ in _pieces(batches))
        for context, token, grams in _blocks(pieces):
            order = _order(grams)
            starts = _starts(grams[order])
            n = np.diff(np.r_[starts, len(grams)])
            at = order[starts]
            context = context[at]
            dealt = _dealt(_part_of(context, parts), context, token[at], n.astype(np.uint32))
            yield _rows_of(_COUNTS, [{"part": part, "context": c, "token": t, "n": x} for part, (c, t, x) in dealt])

    return run


def _number_rows(parts: int, key: np.ndarray, n: np.ndarray, c: np.ndarray, value: np.ndarray) -> list[dict]:
    to = (key % np.uint64(SHARES)).astype(np.int64) * parts + _part_of(key, parts)
    dealt = _dealt(to, key, n, c, value)
    return [{"level": False, "part": part, "key": k, "n": x, "c": y, "value": z} for part, (k, x, y, z) in dealt]


def _words_packed(parts: int) -> Callable:
    """The level of single words and their numbers, of the words of a part."""

    def run(words: pa.Table) -> pa.Table:
        key, n, p = (words[x].to_numpy() for x in ("key", "n", "p"))
        key, zeros = key.view(np.uint64), np.zeros(len(key))
        level = {"key": key, "suffix": zeros.astype(np.uint64), "n": n, "value": p}
        first = {"level": True, "part": words["part"][0].as_py()} | {k: x.tobytes() for k, x in level.items()}
        return _table_of(_SETTLED, [first, *_number_rows(parts, key, n, n, zeros)])

    return run


def _found(length: int, parts: int) -> Callable:
    """Of the runs of ``length`` with contexts in a part, those that occur ``LEAST`` times, next to their contexts in the
    level of shorter runs; and for each part the suffixes there whose probabilities they need."""

    def run(key: tuple, counts: pa.Table, level: pa.Table) -> pa.Table:
        contexts, links, occurs = _unpacked(level, key=np.uint64, suffix=np.uint64, n=np.int64)
        often = np.flatnonzero(occurs >= LEAST)
        often = often[_order(contexts[often])]
        contexts, links, occurs = contexts[often], links[often], occurs[often]
        context, token, n = _unpacked(counts, context=np.uint64, token=np.uint64, n=np.uint32)
        at = _Index(contexts).find(context)
        there = np.flatnonzero(at >= 0)
        at, token, n = at[there], token[there], n[there].astype(np.int64)
        gram = _longer(contexts[at], token, length)
        order = _order(gram)
        starts = _starts(gram[order])
        n = np.add.reduceat(n[order], starts) if len(starts) else n
        enough = np.flatnonzero(n >= LEAST)
        if not len(enough):
            return _table_of(_FOUND, [])
        first, n = order[starts[enough]], n[enough]
        gram, token, at = gram[first], token[first], at[first]
        suffix = _longer(links[at], token, length - 1)
        to = _part_of(suffix, parts)
        order = np.argsort(to, kind="stable")
        gram, suffix, n, at = gram[order], suffix[order], n[order], at[order]
        at, owner = np.unique(at, return_inverse=True)
        # A context occurs as often as the run that it is; a run occurs no less often with a token less.
        rest = occurs[at] - np.bincount(owner, weights=n).astype(np.int64)
        part = key[0].as_py()
        own = {"suffix": suffix, "gram": gram, "n": n, "owner": owner.astype(np.uint32)}
        own |= {"context": contexts[at], "occurs": occurs[at], "rest": rest}
        asks = [{"part": other, "asked": part, "suffix": x} for other, (x,) in _dealt(to[order], suffix)]
        return _table_of(_FOUND, [{"part": part} | {k: x.tobytes() for k, x in own.items()}, *asks])

    return run


def _answers(key: tuple, asks: pa.Table, level: pa.Table) -> pa.Table:
    """The probabilities of suffixes in a part."""
    keys, p = _unpacked(level, key=np.uint64, value=np.float64)
    order = _order(keys)
    index, p = _Index(keys[order]), p[order]
    rows = []
    for ask in asks.select(["asked", "suffix"]).to_pylist():
        at = index.find(np.frombuffer(ask["suffix"], dtype=np.uint64))
        if len(at) and at.min() < 0:
            raise ValueError("a run occurs more often than its suffix")
        rows.append({"part": ask["asked"], "asked": key[0].as_py(), "p": p[at].tobytes()})
    return _table_of(_ANSWERS, rows)


def _settled(length: int, parts: int, least_common: float) -> Callable:
    """The level of the runs of ``length`` and their numbers, by those found in a part and the answers to them.

    What contexts gain is summed in millionths, so that the order of the rows doesn't matter. Common runs are there even
    if they add nothing, so that they aren't sent to their numbers.
    """

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        suffix, gram, n, owner = _unpacked(own, suffix=np.uint64, gram=np.uint64, n=np.int64, owner=np.uint32)
        context, occurs, rest = _unpacked(own, context=np.uint64, occurs=np.int64, rest=np.int64)
        (below,) = _unpacked(answers.sort_by("asked"), p=np.float64)
        likely = np.log((n + (rest + PRIOR)[owner] * np.exp(below)) / (occurs + PRIOR)[owner])
        gained = np.bincount(owner, weights=np.round(n * (likely - below) * 1e6)) / 1e6
        back = np.log((rest + PRIOR) / (occurs + PRIOR))
        kept = np.flatnonzero(gained + rest * back >= GAIN * np.bincount(owner))
        is_kept = np.zeros(len(context), dtype=bool)
        is_kept[kept] = True
        stored = is_kept[owner]
        rows = []
        if length <= DEPTH:
            dealt = _dealt(_part_of(gram, parts), gram, suffix, n, np.where(stored, likely, below))
            rows += [{"level": True, "part": part, "key": k, "suffix": s, "n": x, "value": p} for part, (k, s, x, p) in dealt]
        met = np.flatnonzero(stored | (n >= least_common))
        value = np.where(stored, likely - below - back[owner], 0.0)[met]
        key, occurs = np.r_[gram[met], context[kept]], np.r_[n[met], occurs[kept]]
        value = np.r_[value, back[kept]] / np.log(10.0)
        return _table_of(_SETTLED, rows + _number_rows(parts, key, occurs, np.zeros_like(occurs), value))

    return run


def _numbers(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, c, value, n = _unpacked(pa.Table.from_batches([batch]), key=np.int64, c=np.int64, value=np.float64, n=np.int64)
            at = np.flatnonzero(n >= least)
            columns = [pa.array(key[at]), pa.array(c[at], mask=c[at] == 0), pa.array(value[at]), pa.array(n[at])]
            yield pa.record_batch(columns, names=["key", "c", "value", "n"])

    return run


def _base(count, total: int, distinct: int):
    return (count + 0.5) / (total + 0.5 * (distinct + 1))


@dataclass
class Tree:
    """Number of tokens, words and parts, and the packed numbers that scoring meets."""

    total: int
    distinct: int
    parts: int = 1
    packed: DataFrame | None = None

    @property
    def least_common(self) -> float:
        return COMMON * self.total

    def base_of(self, count):
        """The base probability of words with a count: numbers or a column."""
        return _base(count, self.total, self.distinct)

    def numbers_from(self, least: float) -> DataFrame:
        """Those of ``numbers`` that occur ``least`` times."""
        packed = self.packed.select("key", "c", "value", "n")
        return packed.mapInArrow(giving_back(_numbers(least)), _NUMBERS)

    @property
    def numbers(self) -> DataFrame:
        """The table ``(key, c, value, n)``: the count of a word (null for longer runs), the log10 weight that a run adds,
        and how often it occurs. A run may have two rows, as a context and as a continuation."""
        return self.numbers_from(0)


def _summed(keys: np.ndarray, c: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys with the sums of what they add."""
    order = _order(keys)
    keys = keys[order]
    starts = _starts(keys)
    if not len(starts):
        return keys, c, value
    return keys[starts], np.add.reduceat(c[order], starts), np.add.reduceat(value[order], starts)


def _adds(tree_size: tuple[int, int], keys: np.ndarray, c: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending keys: whether they are a word, its base, what they add."""
    keys, c, value = _summed(keys, c, value)
    return keys, (c > 0).astype(float), np.where(c > 0, np.log10(_base(c, *tree_size)), 0.0), value


def _common_runs(tree: Tree) -> tuple[np.ndarray, ...]:
    """``_adds`` of the runs above ``COMMON``, and a bitmap of their keys.

    No more than ``2 * (DEPTH + 1) / COMMON`` rows, and mostly far fewer.
    """
    found = tree.numbers_from(tree.least_common).select("key", F.coalesce("c", F.lit(0)).alias("c"), "value").toArrow()
    keys, c, value = (found[x].to_numpy() for x in ("key", "c", "value"))
    keys = keys.view(np.uint64)
    bitmap = np.zeros(BITMAP_BITS >> 6, dtype=np.uint64)
    words, bits = bitmap_words(keys)
    bitmap[words] = bits.view(np.uint64)
    return bitmap, *_adds((tree.total, tree.distinct), keys, c, value)


def _pieces_of_share(shared, batches: Iterator[pa.RecordBatch], share: int) -> Iterator[tuple[int, tuple]]:
    """Of the texts (``text, row``) of a piece: their numbers, tokens (in the first share) and what common runs of the share
    add; how many others each has, and these, by length."""
    bitmap, keys, *amounts = shared.value
    index = _Index(keys)
    for tokens, place, numbers in _pieces(batches):
        owner = np.cumsum(place == 0) - 1
        n_tokens = np.bincount(owner, minlength=len(numbers)) if share == 0 else np.zeros(len(numbers), dtype=np.int64)
        sums = [np.zeros(len(numbers)) for _ in amounts]
        others: list[tuple[np.ndarray, np.ndarray]] = []
        for length, _, key in _runs(tokens, place):
            at = np.flatnonzero((place >= length - 1) & (key % np.uint64(SHARES) == share))
            wanted, text = key[at], owner[at]
            is_common = in_bitmap(bitmap, wanted)
            perhaps = np.flatnonzero(is_common)
            entry = index.find(wanted[perhaps])
            is_common[perhaps] = entry >= 0
            met, entry = text[is_common], entry[entry >= 0]
            for total, amount in zip(sums, amounts):
                if length == 1 or amount is amounts[-1]:  # longer runs aren't words
                    total += np.bincount(met, weights=amount[entry], minlength=len(numbers))
            others.append((wanted[~is_common], text[~is_common].astype(np.uint32)))
        key, text = (np.concatenate(x) for x in zip(*others))
        yield len(tokens), (key, text, numbers, n_tokens, *sums, np.array([len(key)]), np.array([len(numbers)]))


def _lookups(shared, share: int, parts: int) -> Callable:
    """The runs of a share in the texts (``text, row``) of a block that are not common, dealt by their hashes; and
    a row with what common runs add. The first share counts the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, text, *own, n_keys, n_texts in _blocks(_pieces_of_share(shared, batches, share)):
            text = text + np.repeat((np.cumsum(n_texts) - n_texts).astype(np.uint32), n_keys)
            block, low = int(own[0][0]), share * parts
            whole = dict(zip((ROW, "n_tokens", "known", "base", "gain"), own))
            rows = [{"part": low + block % parts, "block": block} | {k: x.tobytes() for k, x in whole.items()}]
            for part, (x, y) in _dealt(_part_of(key, parts), key, text):
                rows.append({"part": low + part, "block": block, "key": x, "owner": y})
            yield _rows_of(_LOOKUPS, rows)

    return run


def _met(tree_size: tuple[int, int]) -> Callable:
    """What the runs of a part add to the texts of each block."""

    def run(lookups: pa.Table, numbers: pa.Table) -> pa.Table:
        keys, *amounts = _adds(tree_size, *_unpacked(numbers, key=np.uint64, c=np.int64, value=np.float64))
        (wanted,) = _unpacked(lookups, key=np.uint64)
        entries, done, rows = _Index(keys).find(wanted), 0, []
        for row in lookups.drop_columns("part").to_pylist():
            asked, owner = row.pop("key"), row["owner"]
            if asked is not None:
                text = np.frombuffer(owner, dtype=np.uint32)
                entry = entries[done : done + len(text)]
                done += len(text)
                text, entry = text[entry >= 0], entry[entry >= 0]
                texts = np.flatnonzero(np.bincount(text))
                row["owner"] = texts.astype(np.uint32).tobytes()
                for name, amount in zip(("known", "base", "gain"), amounts):
                    row[name] = np.bincount(text, weights=amount[entry])[texts].tobytes()
            rows.append(row)
        return _table_of(_SUMS, rows)

    return run


def _sums_of_texts(sums: pa.Table) -> pa.Table:
    """What all runs of a share add to each text of a block."""
    whole = sums.filter(pc.is_valid(sums[ROW]))
    found = sums.filter(pc.is_null(sums[ROW]))
    kinds = {"known": np.float64, "base": np.float64, "gain": np.float64}
    row, n_tokens, *amounts = _unpacked(whole, **{ROW: np.int64}, n_tokens=np.int64, **kinds)
    text, *more = _unpacked(found, owner=np.uint32, **kinds)
    amounts = [x + np.bincount(text, weights=y, minlength=len(row)) for x, y in zip(amounts, more)]
    return pa.table(dict(zip((ROW, "n_tokens", "known", "base", "gain"), (row, n_tokens, *amounts))))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _by_part(left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, schema)


def _grow(tree: Tree, texts: DataFrame, words: DataFrame) -> DataFrame:
    """Packed numbers of all runs, shorter contexts first, so that suffixes are settled before."""
    spark, parts = texts.sparkSession, tree.parts
    folder, before = new_path(spark, "lm-level"), None
    part = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(parts).cast("long"), 32).cast("int")
    words = words.select(part.alias("part"), "key", "n", F.log(tree.base_of(F.col("n"))).alias("p"))
    level = materialise(words.groupBy("part").applyInArrow(_words_packed(parts), _SETTLED), "words", f"{folder}/words")
    numbers = []
    for length in range(2, DEPTH + 3):
        numbers.append(materialise(level.filter("not level").drop("level", "suffix"), "lm-numbers"))
        if before:
            drop_path(spark, before)
        if length > DEPTH + 1:
            break
        shorter, before, folder = level.filter("level"), folder, new_path(spark, "lm-level")
        shares = []
        for share in range(COUNT_SHARES):

            def one(length=length, share=share, shorter=shorter) -> DataFrame:
                counts = texts.mapInArrow(giving_back(_gram_counts(length, share, parts)), _COUNTS)
                level = shorter.select("part", "key", "suffix", "n")
                found = materialise(_by_part(counts, level, _found(length, parts), _FOUND), "lm-found")
                asks = found.filter("asked is not null").select("part", "asked", "suffix")
                answers = _by_part(asks, shorter.select("part", "key", "value"), _answers, _ANSWERS)
                return _by_part(found.filter("asked is null"), answers, _settled(length, parts, tree.least_common), _SETTLED)

            shares.append(settle(spark, f"share-{share}", one, folder))
        level = _union(shares)
    drop_path(spark, folder)
    return _union(numbers)


def train(texts: DataFrame) -> Tree:
    """The tree of a one-column frame of training texts. An empty table gives a tree without runs, whose base is that
    of one unknown word; a long text is taken whole, and tokens of many texts or one are counted in blocks."""
    tree = Tree(0, 0)

    def numbers() -> DataFrame:
        counts = texts.mapInArrow(giving_back(_single_counts), "key long, n long")
        words = materialise(counts.groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
        total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        tree.total, tree.distinct, tree.parts = int(total), int(distinct), max(1, -(-int(total) // PART))
        return _grow(tree, texts, words)

    tree.packed = settle(texts.sparkSession, "lm-numbers", numbers)
    return tree


def score(docs: DataFrame, tree: Tree, doc_id: Column, text: Column, held_out: Column, stored: bool = False) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Null and empty texts are one token, the end; texts of any length are scored whole. Repeated rows and rows
    without an id are scored each. An empty table gives an empty one. Only the three given columns are looked at.
    ``stored`` is that of ``with_row_numbers``.
    """
    spark, size = docs.sparkSession, (tree.total, tree.distinct)
    rows = docs.select(text.cast("string").alias("text"), doc_id.cast("long").alias("doc_id"), held_out.alias("held_out"))
    rows = with_row_numbers(rows, stored).select("text", "doc_id", "held_out", ROW)
    shared = spark.sparkContext.broadcast(_common_runs(tree))
    none = F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out")
    amounts = "n_tokens", "known", "base", "gain"
    zeros = F.lit(0).cast("long").alias("n_tokens"), *[F.lit(0.0).alias(x) for x in amounts[1:]]
    whole = [rows.select(ROW, "doc_id", "held_out", *zeros)]
    for share in range(SHARES):
        lookups = rows.select("text", ROW).mapInArrow(giving_back(_lookups(shared, share, tree.parts)), _LOOKUPS)
        in_share = F.col("part").between(share * tree.parts, (share + 1) * tree.parts - 1)
        numbers = tree.packed.filter(in_share).select("part", "key", "c", "value")
        sums = _by_part(lookups, numbers, _met(size), _SUMS).groupBy("block").applyInArrow(_sums_of_texts, _TEXTS)
        whole.append(materialise(sums, "lm-sums").select(ROW, *none, *amounts))
    sums = _union(whole).groupBy(ROW).agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("known").cast("long").alias("n_known"),
        F.sum("base").alias("base"),
        F.sum("gain").alias("gain"),
    )
    unknown = F.lit(float(np.log10(tree.base_of(0)))) * (F.col("n_tokens") - F.col("n_known"))
    return sums.withColumn("base_score", F.col("base") + unknown).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"),
        "base_score", (F.col("base_score") + F.col("gain")).alias("score"),
    )
