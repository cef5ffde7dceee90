"""Language identification by error-correcting output codes.

Every language has a code word of bits. For each bit a linear classifier over hashed byte n-grams tells
languages with the bit from those without: its weights are the log ratio of the two sides' n-gram
distributions, its threshold and scale come from what each language's own distribution gives. A text is
given the language whose word costs the least logistic loss over all bits, each weighted by how well its
classifier keeps the two sides apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import giving_back
from corpusloom.llm.words import buffers, spans

#: Byte n-grams of one to this many bytes, and the places they are hashed to.
ORDERS = 3
BUCKETS = 1 << 14
#: Texts are worked on in pieces of this size.
PIECE_BYTES = 1 << 18
#: Languages with code words of all possible columns; beyond, columns are drawn.
EXHAUSTIVE = 7
MAX_LANGUAGES = 1000
SMOOTHING = 0.5
#: The loss per normalised margin, and the n-grams a text needs to count in full.
STEEPNESS = 4.0
FULL_EVIDENCE = 200
#: Two best losses closer than this leave a text ambiguous.
AMBIGUOUS = 0.5
UNDETERMINED = "und"

# Upper-case ASCII becomes lower case, all other ASCII that is no letter becomes a space.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    centre: np.ndarray
    scale: np.ndarray
    trust: np.ndarray  # weight of each bit in the loss


def code_words(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` languages; no two columns split the languages alike."""
    if n < 2:
        return np.ones((n, 0), dtype=np.int64)
    if n <= EXHAUSTIVE:
        columns = np.arange(1, 1 << (n - 1))
        upper = ((columns[None, :] >> np.arange(n - 1)[:, None]) & 1) * 2 - 1
        return np.concatenate([upper, -np.ones((1, len(columns)), dtype=np.int64)])
    bits = 10 * int(np.ceil(np.log2(n)))
    best, reach = None, -1
    for seed in range(50):
        drawn = np.random.default_rng(seed).integers(0, 2, (n, bits)) * 2 - 1
        drawn = drawn[:, np.abs(drawn.sum(axis=0)) < n]
        apart = (drawn.shape[1] - drawn @ drawn.T) // 2 + np.eye(n, dtype=np.int64) * bits
        if apart.min() > reach:
            best, reach = drawn, apart.min()
    return best


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts ``first`` to ``last``: their bytes, folded, two spaces after each, and where each begins."""
    bounds, raw = buffers(column)
    for first, last in spans(bounds, PIECE_BYTES):
        own = bounds[first : last + 1] - bounds[first]
        starts = own[:-1] + 2 * np.arange(last - first)
        padded = np.full(own[-1] + 2 * (last - first), 32, dtype=np.uint8)
        shift = np.repeat(2 * np.arange(last - first), np.diff(own))
        padded[np.arange(own[-1]) + shift] = _FOLD[raw[bounds[first] : bounds[last]]]
        yield first, last, padded, starts


def _buckets(data: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1 to ``ORDERS`` the bucket of the n-gram that begins at each byte.

    Those that begin in the spaces after a text are all spaces, whatever text comes next.
    """
    key = np.zeros(len(data), dtype=np.uint32)
    ends, spaces = np.r_[starts[1:], len(data)], 0
    for n in range(1, ORDERS + 1):
        key = key * np.uint32(256)
        key[: len(data) - n + 1] += data[n - 1 :]
        spaces = spaces * 256 + 32
        key[ends - 1] = key[ends - 2] = spaces
        salted = (key + np.uint32(n << 28)) * np.uint32(2654435769)
        yield (salted >> np.uint32(32 - 14)).astype(np.int64)


def _counter(languages: dict[str, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * BUCKETS, dtype=np.int64)
        for batch in batches:
            own = np.array([languages[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for first, last, data, starts in _pieces(batch.column(0)):
                lengths = np.diff(np.r_[starts, len(data)])
                base = np.repeat(own[first:last] * BUCKETS, lengths)
                for found in _buckets(data, starts):
                    counts += np.bincount(base + found, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array(used // BUCKETS), pa.array(used % BUCKETS), pa.array(counts[used])],
            names=["language", "bucket", "n"],
        )

    return run


def train(rows: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """Learn from all ``rows`` that name a language.

    The n-gram counts of every language are summed up by Spark; what reaches the driver is one number per
    language and bucket. Rows without a language are passed over. No rows give a model of no languages.
    """
    named = rows.select(F.col(text).alias("text"), F.col(language).alias("lang")).filter("lang is not null")
    found = named.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r[0] for r in found)
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        counter = _counter({x: i for i, x in enumerate(languages)})
        summed = named.mapInArrow(giving_back(counter), "language long, bucket long, n long")
        totals = summed.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[totals["language"].to_numpy(), totals["bucket"].to_numpy()] = totals["n"].to_numpy()
    return fit(languages, counts)


def fit(languages: list[str], counts: np.ndarray) -> Model:
    """The bit classifiers, in closed form from the n-gram counts of each language."""
    words = code_words(len(languages))
    shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    bits = words.shape[1]
    weights, centre, scale, trust = np.zeros((BUCKETS, bits)), np.zeros(bits), np.ones(bits), np.zeros(bits)
    for b in range(bits):
        on, off = words[:, b] > 0, words[:, b] < 0
        weights[:, b] = np.log(shares[on].mean(axis=0) / shares[off].mean(axis=0))
        expected = shares @ weights[:, b]
        low, high = expected[off].max(), expected[on].min()
        centre[b], gap = (low + high) / 2, (high - low) / 2
        scale[b], trust[b] = max(gap, 1e-6), max(gap, 1e-6)
    if bits:
        trust *= bits / trust.sum()
    return Model(languages, words, weights.astype(np.float32), centre, scale, trust)


def decode(model: Model, margins: np.ndarray, n_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The language of each text by the bits' mean weights, its score, and whether it is ambiguous."""
    evidence = np.sqrt(np.minimum(1.0, n_grams / FULL_EVIDENCE))[:, None]
    normal = np.clip((margins - model.centre) / model.scale, -5, 5) * STEEPNESS * evidence
    losses = np.zeros((len(margins), len(model.languages)))
    for i, word in enumerate(model.words):
        losses[:, i] = (model.trust * np.logaddexp(0.0, -word * normal)).sum(axis=1)
    best = losses.argmin(axis=1)
    least = losses[np.arange(len(best)), best]
    likely = np.exp(least[:, None] - losses)
    score = 1.0 / likely.sum(axis=1)
    losses[np.arange(len(best)), best] = np.inf
    return best, score, losses.min(axis=1) - least < AMBIGUOUS


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predictor(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = np.ascontiguousarray(model.weights.T)
        for batch in batches:
            bounds, raw = buffers(batch.column(0))
            n = len(batch)
            margins, n_grams = np.zeros((n, model.words.shape[1])), np.zeros(n)
            letters = np.zeros(n, dtype=bool)
            for first, last, data, starts in _pieces(batch.column(0)):
                sums = np.zeros((last - first, model.words.shape[1]))
                for found in _buckets(data, starts):
                    for bit, own in enumerate(weights):
                        sums[:, bit] += np.add.reduceat(own[found], starts)
                lengths = np.diff(np.r_[starts, len(data)]) * ORDERS
                margins[first:last] = sums / lengths[:, None]
                n_grams[first:last] = lengths
                letters[first:last] = np.maximum.reduceat((data >= 97) & (data < 123), starts)
            for i in np.flatnonzero(~letters):
                letters[i] = _has_letter(raw[bounds[i] : bounds[i + 1]].tobytes())
            if len(model.languages):
                best, score, unclear = decode(model, margins, n_grams)
            else:
                best, score, unclear, letters = np.zeros(n, int), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
            names = np.array([*model.languages, UNDETERMINED], dtype=object)
            yield pa.record_batch(
                [
                    *batch.columns[1:],
                    pa.array(names[np.where(letters, best, len(model.languages))], type=pa.string()),
                    pa.array(np.where(letters, score, 0.0)),
                    pa.array(unclear | ~letters),
                ],
                names=[*batch.schema.names[1:], "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` columns of every row with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Only the text is looked at, whole. A text that is null, empty or has no letter is ``und`` with score
    0, and so is every text if the model has no language. Repeated rows are judged each.
    """
    rows = docs.select(F.col(text).cast("string").alias("__text"), *[c.alias(n) for n, c in keep.items()])
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.mapInArrow(giving_back(_predictor(docs.sparkSession.sparkContext.broadcast(model))), schema)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are given a language with a score of ``least`` or more, with all their columns."""
    names = {f"__column_{i}": c for i, c in enumerate(docs.columns)}
    judged = predict(docs, model, {n: docs[c] for n, c in names.items()}, text)
    kept = judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*[F.col(n).alias(c) for n, c in names.items()])
