"""Exact top-k search by integer inner product, with a table of distances to pivots.

Vectors are packed into blocks; a block has its vectors, their squared lengths and their distances to a
set of pivots, which is the same for all blocks of one dimension. For a query and a vector the largest
difference of their distances to a pivot is a lower bound of their distance, so

    q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2

has an upper bound. The vectors of a block are evaluated by descending bound until k scores are known and
the next bound is below the least of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise

#: Vectors of a block, queries of a block, pivots, and vectors that are evaluated first.
BLOCK = 4096
QUERIES = 512
PIVOTS = 32
STEP = 64
#: Queries whose bounds are worked out at once.
BOUNDED = 64
SCALE = 256

_BLOCKS = "dim int, block long, ids array<long>, vectors binary, to_pivots binary"
_SCORES = "query_id long, vec_id long, score long"
#: Integers up to here are exact as floating point numbers.
_EXACT = 1 << 53


def integral(vector: Column) -> Column:
    """floor(256 * x) of every component, or null if the vector is or holds null or a non-finite number."""
    limit = float(1 << 62)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(
        vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(limit)), F.lit(-limit)))
    )
    return F.when(vector.isNotNull() & F.coalesce(usable, F.lit(False)), scaled)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; beyond 64 bits the nearest 64-bit number."""
    most = _reach(a) * _reach(b) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _reach(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = vectors.astype(np.float64), pivots.astype(np.float64)
    squares = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(squares, 0.0))


def pivots_of(dim: int, sampled: dict[int, np.ndarray]) -> np.ndarray:
    """The pivots of one dimension: sampled vectors, or drawn ones for a dimension that has none."""
    if dim in sampled:
        return sampled[dim]
    return np.round(np.random.default_rng(dim).standard_normal((PIVOTS, dim)) * SCALE)


def _packer(size: int, sampled: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            vectors = np.array([x[1] for x in rows], dtype=np.int64).reshape(len(rows), dim)
            to_pivots = _distances(vectors, pivots_of(dim, sampled))
            return pa.record_batch(
                [
                    pa.array([dim], type=pa.int32()),
                    pa.array([rows[0][2]], type=pa.int64()),
                    pa.array([[x[0] for x in rows]], type=pa.list_(pa.int64())),
                    pa.array([vectors.tobytes()], type=pa.binary()),
                    pa.array([to_pivots.tobytes()], type=pa.binary()),
                ],
                names=["dim", "block", "ids", "vectors", "to_pivots"],
            )

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                dim = len(row[1])
                held.setdefault(dim, []).append(row)
                if len(held[dim]) >= size:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return run


def _unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(row[f"{side}_ids"], dtype=np.int64)
    vectors = np.frombuffer(row[f"{side}_vectors"], dtype=np.int64).reshape(len(ids), row["dim"])
    return ids, vectors, np.frombuffer(row[f"{side}_to_pivots"]).reshape(len(ids), -1)


def _scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products; floating point numbers are given only where they are exact."""
    if vectors.dtype == np.float64:
        return (vectors @ query).astype(np.int64)
    return products(query[None, :], vectors)[0]


def best_of_block(
    query: np.ndarray, bounds: np.ndarray, others: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best ``(score, id)`` among the vectors numbered ``others``, taken by descending bound until none can be better."""
    order = others[np.argsort(-bounds[others])]
    found_ids, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, step = 0, STEP
    while at < len(order):
        if len(found) >= k and bounds[order[at]] < found[k - 1]:
            break
        # Bounds that have not ended the search yet will hardly do so soon: ever more vectors are taken at a time.
        chosen = order[at : at + step]
        found = np.concatenate([found, _scores(query, vectors[chosen])])
        found_ids = np.concatenate([found_ids, ids[chosen]])
        # Ties to the smaller id; equal ids can't be told apart.
        best = np.lexsort((found_ids, _descending(found)))[:k]
        found, found_ids = found[best], found_ids[best]
        at, step = at + step, 2 * step
    return found, found_ids


def _descending(scores: np.ndarray) -> np.ndarray:
    return ~scores  # no overflow at the smallest number


def bounds_of(queries: np.ndarray, to_pivots: np.ndarray, vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of some queries (rows) with the vectors of a block (columns)."""
    apart = np.zeros((len(queries), len(vectors)))
    for p in range(pivots.shape[1]):
        np.maximum(apart, np.abs(to_pivots[:, p, None] - pivots[None, :, p]), out=apart)
    squares = (queries.astype(np.float64) ** 2).sum(axis=1)[:, None] + (vectors.astype(np.float64) ** 2).sum(axis=1)[None, :]
    # Rounding of the distances is made up for, so no bound is too low.
    return (squares - np.maximum(apart - 1e-6 * (1 + apart), 0.0) ** 2) / 2 + 1e-9 * squares + 1.0


def _searcher(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                q_ids, queries, q_pivots = _unpack(row, "q")
                ids, vectors, pivots = _unpack(row, "x")
                if _reach(queries) * _reach(vectors) * vectors.shape[1] < _EXACT:
                    queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for at in range(0, len(q_ids), BOUNDED):
                    part = slice(at, at + BOUNDED)
                    bounds = bounds_of(queries[part], q_pivots[part], vectors, pivots)
                    for q_id, query, bound in zip(q_ids[part], queries[part], bounds):
                        others = np.flatnonzero(ids != q_id)
                        found, found_ids = best_of_block(query, bound, others, ids, vectors, k)
                        out.append((np.full(len(found), q_id), found_ids, found))
                if out:
                    yield pa.record_batch(
                        [pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "score"]
                    )

    return run


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors`` with the largest inner product for
    every row that ``is_query`` chooses, ties to the smaller id.

    Components are taken as floor(256 * x). A query's candidates are all rows with another id and as many
    components; rows that repeat both id and vector count once, and rows that share an id only are
    candidates each. If several queries share an id, their candidates are ranked together. Rows without an
    id or a vector, and vectors that hold null or a non-finite number, take no part. Scores beyond 64 bits are the
    nearest 64-bit number. Fewer candidates give fewer ranks; an empty table gives an empty one. Other
    columns are not looked at.

    Every query meets every block of vectors: the work is queries times vectors, in pairs of blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), integral(F.col(vector)).alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).dropDuplicates(["id", "v"])
    rows = materialise(rows.select("id", "v", F.xxhash64("id").alias("block"), "q"), "topk-vectors")

    sampled: dict[int, list] = {}
    for row in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect():
        sampled.setdefault(len(row.v), []).append(row.v)
    pivots = {dim: np.array(found, dtype=np.float64) for dim, found in sampled.items()}

    packed = materialise(rows.select("id", "v", "block").mapInArrow(_packer(BLOCK, pivots), _BLOCKS), "topk-blocks")
    buckets = max(1, -(-rows.filter("q").count() // QUERIES))
    asked = rows.filter("q").select("id", "v", "block").repartition(buckets, "block")
    asked = asked.mapInArrow(_packer(QUERIES, pivots), _BLOCKS)
    # Every block of queries is in one bucket, and every block of vectors is sent to all buckets.
    parts = ("ids", "vectors", "to_pivots")
    q = asked.select("dim", F.pmod("block", F.lit(buckets)).alias("bucket"), *[F.col(c).alias(f"q_{c}") for c in parts])
    sent = packed.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    x = sent.select("dim", F.col("bucket").cast("long").alias("bucket"), *[F.col(c).alias(f"x_{c}") for c in parts])
    scores = x.join(materialise(q, "topk-queries"), ["dim", "bucket"]).mapInArrow(_searcher(k), _SCORES)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
