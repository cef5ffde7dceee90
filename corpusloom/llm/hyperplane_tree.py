"""Hard-negative mining with a multiway hyperplane tree (GNAT) over integer vectors.

A node of the tree has a few split points; a vector belongs to the nearest of them, and every split point
knows the range of its distances to the vectors of each subtree beside it. Vectors get one more component
that gives all of them the same length, so that an inner product with an anchor is a distance to it and a
window of scores is an annulus around it. A subtree is left out as soon as one split point's range for it
doesn't meet the distances that the annulus allows; the vectors of the leaves that remain are compared exactly.

The split points come from a bounded sample. Every row is put into its leaf, the ranges are taken over all
rows, and the rows of a leaf lie in blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, prepare
from corpusloom.llm.exact_topk import integral, products

#: Split points of a node, rows that a leaf is planned for, and the sample the split points come from.
FAN = 16
LEAF = 4096
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 32 << 20
#: Anchors that are compared with a block at once.
ANCHORS = 512

POSITIVES = 5
NEGATIVES = 3
#: A negative has at least and at most this percentage of the positive's score.
LOW, HIGH = 50, 95

_LEAST = np.iinfo(np.int64).min
_RANGES = "dim int, node int, i int, j int, low double, high double, most double"
_PLACED = "row long, id long, label int, v array<long>, anchor boolean, dim int, leaf int"
_BLOCKS = "dim int, leaf int, block long, rows binary, ids binary, labels binary, vectors binary"
_FOUND = "row long, other_id long, other_row long, score long"
_MINED = "row long, positive int, negative_id long, negative_score long"


@dataclass
class Node:
    """Split points, and for each of them the node below it or the number of its leaf."""

    number: int
    points: np.ndarray
    below: list
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    """The tree of the vectors of one length; ``most`` is the squared length all of them are raised to."""

    most: float
    nodes: list[Node]
    leaves: int

    def place(self, raised: np.ndarray) -> tuple[np.ndarray, list]:
        """The leaf of every vector, and for each node it passes the distances to all split points."""
        leaf, seen = np.zeros(len(raised), dtype=np.int32), []
        waiting = [(self.nodes[0], np.arange(len(raised)))] if self.nodes else []
        while waiting:
            node, at = waiting.pop()
            apart = distances(raised[at], node.points)
            nearest = apart.argmin(axis=1)
            seen.append((node, apart, nearest))
            for j, below in enumerate(node.below):
                mine = at[nearest == j]
                if isinstance(below, Node):
                    if len(mine):
                        waiting.append((below, mine))
                else:
                    leaf[mine] = below
        return leaf, seen

    def reached(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Which leaves may have vectors between ``inner`` and ``outer`` from each anchor: (anchors, leaves)."""
        open_ = np.zeros((len(anchors), max(1, self.leaves)), dtype=bool)
        if not self.nodes:
            open_[:] = True
            return open_
        waiting = [(self.nodes[0], np.ones(len(anchors), dtype=bool))]
        while waiting:
            node, alive = waiting.pop()
            apart = distances(anchors, node.points)
            slack = 1e-6 * (1 + apart + outer[:, None])
            # Distances from split point i that the triangle inequality leaves to what lies in the annulus.
            least = np.maximum(apart - outer[:, None], inner[:, None] - apart) - slack
            most = apart + outer[:, None] + slack
            for j, below in enumerate(node.below):
                meets = (least <= node.high[:, j]) & (most >= node.low[:, j])
                into = alive & meets.all(axis=1)
                if isinstance(below, Node):
                    if into.any():
                        waiting.append((below, into))
                else:
                    open_[into, below] = True
        return open_


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * x @ points.T
    return np.sqrt(np.maximum(squares, 0.0))


def raise_(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component, which gives all the squared length ``most``."""
    x = vectors.astype(np.float64)
    rest = np.maximum(most - (x * x).sum(axis=1), 0.0)
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points, each the farthest from those before; equal ones count once."""
    chosen = [0]
    apart = distances(points, points[:1])[:, 0]
    while len(chosen) < n:
        at = int(apart.argmax())
        if apart[at] <= 1e-6:
            break
        chosen.append(at)
        apart = np.minimum(apart, distances(points, points[at : at + 1])[:, 0])
    return points[chosen]


def plant(sample: np.ndarray, rows: int, most: float, fan: int, leaf: int) -> Tree:
    """A tree for about ``rows`` vectors, from a sample of them."""
    tree = Tree(most, [], 0)
    raised = raise_(sample, most)

    def grow(points: np.ndarray, expected: float) -> Node | int:
        split = far_apart(points, min(fan, max(2, -(-int(expected) // leaf)))) if expected > leaf and len(points) > 1 else points[:1]
        if len(split) < 2:
            tree.leaves += 1
            return tree.leaves - 1
        node = Node(len(tree.nodes), split, [])
        tree.nodes.append(node)
        nearest = distances(points, split).argmin(axis=1)
        node.below = [grow(points[nearest == j], expected * (nearest == j).mean()) for j in range(len(split))]
        node.low = np.full((len(split), len(split)), np.inf)
        node.high = np.full((len(split), len(split)), -np.inf)
        return node

    if len(raised):
        grow(raised, rows)
    return tree


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield int(dim), part, _matrix(part.column("v"), int(dim))


def _placer(trees: dict[int, Tree]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, vectors in _by_dim(batch):
                leaf, _ = trees[dim].place(raise_(vectors, trees[dim].most))
                columns = [part.column(c) for c in ("row", "id", "label", "v", "anchor", "dim")]
                columns.append(pa.array(leaf, type=pa.int32()))
                yield pa.record_batch(columns, names=["row", "id", "label", "v", "anchor", "dim", "leaf"])

    return run


def _ranger(trees: dict[int, Tree]) -> Callable:
    """The ranges of a task's rows: a row per node, split point and subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, vectors in _by_dim(batch):
                _, seen = trees[dim].place(raise_(vectors, trees[dim].most))
                for node, apart, nearest in seen:
                    n = len(node.points)
                    low, high = found.setdefault((dim, node.number), (np.full((n, n), np.inf), np.full((n, n), -np.inf)))
                    for j in np.unique(nearest):
                        own = apart[nearest == j]
                        low[:, j] = np.minimum(low[:, j], own.min(axis=0))
                        high[:, j] = np.maximum(high[:, j], own.max(axis=0))
        for (dim, number), (low, high) in found.items():
            i, j = (x.ravel() for x in np.indices(low.shape))
            yield pa.record_batch(
                [
                    pa.array(np.full(low.size, dim), type=pa.int32()),
                    pa.array(np.full(low.size, number), type=pa.int32()),
                    pa.array(i, type=pa.int32()),
                    pa.array(j, type=pa.int32()),
                    pa.array(low.ravel()),
                    pa.array(high.ravel()),
                    pa.array(np.full(low.size, trees[dim].most)),
                ],
                names=["dim", "node", "i", "j", "low", "high", "most"],
            )

    return run


def _packer(size: int) -> Callable:
    """Rows of a leaf into blocks of at most ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            rows, ids, labels, vectors = (np.concatenate(x) for x in zip(*held.pop(key)))
            packed = [x.astype(np.int64).tobytes() for x in (rows, ids, labels, vectors)]
            columns = [pa.array([key[0]], type=pa.int32()), pa.array([key[1]], type=pa.int32()), pa.array([int(rows[0])])]
            return pa.record_batch(
                columns + [pa.array([x], type=pa.binary()) for x in packed],
                names=["dim", "leaf", "block", "rows", "ids", "labels", "vectors"],
            )

        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            for dim, part, vectors in _by_dim(batch):
                own = leaves[batch.column("dim").to_numpy() == dim]
                rows, ids, labels = (part.column(c).to_numpy() for c in ("row", "id", "label"))
                for leaf in np.unique(own):
                    at, key = np.flatnonzero(own == leaf), (dim, int(leaf))
                    while len(at):
                        room = size - sum(len(x[0]) for x in held.get(key, []))
                        take, at = at[:room], at[room:]
                        held.setdefault(key, []).append((rows[take], ids[take], labels[take], vectors[take]))
                        if len(take) == room:
                            yield block(key)
        for key in list(held):
            yield block(key)

    return run


def _unpack(row: dict, side: str = "") -> list[np.ndarray]:
    rows, ids, labels = (np.frombuffer(row[f"{side}{c}"], dtype=np.int64) for c in ("rows", "ids", "labels"))
    return [rows, ids, labels, np.frombuffer(row[f"{side}vectors"], dtype=np.int64).reshape(len(rows), row["dim"])]


def best_of_rows(scores: np.ndarray, usable: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """For each row of ``scores`` its k highest usable ones, ties by id: (row, column) pairs in order."""
    masked = np.where(usable, scores, _LEAST)
    if masked.shape[1] > k:
        bar = -np.partition(-(masked.astype(np.float64)), k - 1, axis=1)[:, k - 1]
        # Rounding may only let more through.
        usable = usable & (masked >= np.nextafter(bar, -np.inf)[:, None])
    at, column = np.nonzero(usable)
    order = np.lexsort((rows[column], ids[column], ~scores[at, column], at))
    at, column = at[order], column[order]
    first = np.searchsorted(at, at)
    top = np.arange(len(at)) - first < k
    return at[top], column[top]


def _percent(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """score * percent / 100, rounded up or down, without leaving 64 bits."""
    hundreds, rest = np.divmod(score, 100)
    part = rest * percent
    return hundreds * percent + (-(-part // 100) if up else part // 100)


def _reaching(trees: dict[int, Tree], home: bool) -> Callable:
    """For each block of anchors the leaves that it must be compared with, and the anchors that reach them.

    A row has an anchor's least wanted score ``least`` and its highest ``most``; both null stand for any score.
    With ``home``, an anchor reaches the leaf it lies in and no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, vectors in _by_dim(batch):
                tree = trees[dim]
                own = np.array(part.column("leaf").to_pylist(), dtype=np.int64)
                if home:
                    open_ = np.zeros((len(part), max(1, tree.leaves)), dtype=bool)
                    open_[np.arange(len(part)), own] = True
                else:
                    x = vectors.astype(np.float64)
                    square = (x * x).sum(axis=1)
                    least = part.column("least").fill_null(_LEAST).to_numpy().astype(np.float64)
                    most = part.column("most").fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.float64)
                    slack = 1e-9 * (square + tree.most) + 1.0
                    outer = np.sqrt(np.maximum(square + tree.most - 2 * least + slack, 0.0))
                    inner = np.sqrt(np.maximum(square + tree.most - 2 * most - slack, 0.0))
                    anchors = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
                    open_ = tree.reached(anchors, inner, outer)
                for leaf in np.flatnonzero(open_.any(axis=0)):
                    chosen = part.filter(pa.array(open_[:, leaf]))
                    chosen = chosen.drop_columns(["leaf"]).append_column("leaf", pa.array([int(leaf)] * len(chosen), type=pa.int32()))
                    yield chosen

    return run


def _asker(extra: list[str]) -> Callable:
    """Anchors of one leaf into packed blocks of at most ``ANCHORS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def block(key: tuple[int, int], rows: list) -> pa.RecordBatch:
            columns = [pa.array([key[0]], type=pa.int32()), pa.array([key[1]], type=pa.int32())]
            for c in ("row", "id", "label", "v"):
                columns.append(pa.array([np.array([r[c] for r in rows], dtype=np.int64).tobytes()], type=pa.binary()))
            for c in extra:
                columns.append(pa.array([[r[c] for r in rows]], type=pa.list_(pa.list_(pa.int64()))))
            return pa.record_batch(columns, names=["dim", "leaf", "a_rows", "a_ids", "a_labels", "a_vectors", *extra])

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["dim"], row["leaf"])
                held.setdefault(key, []).append(row)
                if len(held[key]) >= ANCHORS:
                    yield block(key, held.pop(key))
        for key, rows in held.items():
            yield block(key, rows)

    return run


def _positives(k: int) -> Callable:
    """The k best rows of an anchor's label in each block it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                a_rows, a_ids, a_labels, anchors = _unpack(row, "a_")
                rows, ids, labels, vectors = _unpack(row)
                scores = products(anchors, vectors)
                usable = (a_labels[:, None] == labels[None, :]) & (a_ids[:, None] != ids[None, :])
                at, column = best_of_rows(scores, usable, ids, rows, k)
                if len(at):
                    found = [a_rows[at], ids[column], rows[column], scores[at, column]]
                    yield pa.record_batch([pa.array(x) for x in found], names=["row", "other_id", "other_row", "score"])

    return run


def _negatives(k: int, low: int, high: int) -> Callable:
    """The k best rows of other labels inside the window of each positive of an anchor, for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                a_rows, _, a_labels, anchors = _unpack(row, "a_")
                rows, ids, labels, vectors = _unpack(row)
                scores = products(anchors, vectors)
                differs = a_labels[:, None] != labels[None, :]
                positive_scores = row["scores"]
                for slot in range(max(map(len, positive_scores))):
                    have = np.flatnonzero([len(x) > slot for x in positive_scores])
                    score = np.array([positive_scores[h][slot] for h in have], dtype=np.int64)
                    own = scores[have]
                    usable = (
                        differs[have]
                        & (own >= _percent(score, low, True)[:, None])
                        & (own <= _percent(score, high, False)[:, None])
                    )
                    at, column = best_of_rows(own, usable, ids, rows, k)
                    if len(at):
                        yield pa.record_batch(
                            [
                                pa.array(a_rows[have[at]]),
                                pa.array(np.full(len(at), slot + 1), type=pa.int32()),
                                pa.array(ids[column]),
                                pa.array(own[at, column]),
                            ],
                            names=["row", "positive", "negative_id", "negative_score"],
                        )

    return run


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    fan: int = FAN,
    leaf: int = LEAF,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For each row that ``is_anchor`` chooses, its positives are the first ``positives`` other rows of its label
    by falling inner product, ties to the smaller id; for each of them come the first ``negatives`` rows of
    other labels whose score is between ``low`` and ``high`` percent of the positive's. Components are taken as
    floor(256 * x). Fewer rows give fewer ranks, and a positive below 0 has no negatives, as its window is
    empty. Rows without id, label or vector, and vectors that hold null or a non-finite number, take no part.
    Rows equal in id, label and vector count once; rows that share only an id are rows of their own, never each
    other's positives, and as anchors they are ranked each by itself. Only vectors of the same length are
    compared. Scores beyond 64 bits are the nearest 64-bit number. An empty table gives an empty result. Other columns
    are not looked at.
    """
    spark = vectors.sparkSession
    prepare(spark)
    usable = vectors.select(
        F.col(vec_id).cast("long").alias("id"),
        label.cast("int").alias("label"),
        integral(F.col(vector)).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).filter("id is not null and label is not null and v is not null")
    usable = usable.dropDuplicates(["id", "label", "v"])
    usable = usable.withColumn("row", F.xxhash64("id", "label", "v")).withColumn("dim", F.size("v"))
    rows = materialise(usable.select("row", "id", "label", "v", "anchor", "dim"), "mining-rows")

    trees = _trees(rows, fan, leaf)
    placed = materialise(rows.mapInArrow(_placer(trees), _PLACED), "mining-leaves")
    sizes = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / leaf).cast("int").alias("parts"))
    # A leaf larger than a block is dealt over as many tasks as it has blocks.
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    dealt = placed.join(F.broadcast(sizes), ["dim", "leaf"]).withColumn("part", part).repartition("dim", "leaf", "part")
    blocks = materialise(
        dealt.select("row", "id", "label", "v", "dim", "leaf").mapInArrow(_packer(leaf), _BLOCKS), "mining-blocks"
    )

    anchors = placed.filter("anchor").drop("anchor")
    wanted = anchors.withColumns({"least": F.lit(None).cast("long"), "most": F.lit(None).cast("long")})
    first = _compare(wanted, blocks, trees, True, positives)
    # What the anchor's own leaf has bounds the scores that other leaves must beat.
    bars = first.groupBy("row").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
    least = F.when(F.size("scores") >= positives, F.col("scores")[positives - 1])
    bounded = anchors.join(bars, "row", "left").withColumns({"least": least, "most": F.lit(None).cast("long")}).drop("scores")
    found = materialise(_compare(bounded, blocks, trees, False, positives), "mining-positives")

    windows = found.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(F.expr("~score").alias("score"), "other_id", "other_row"))).alias("own")
    )
    scores = F.transform("own", lambda x: F.bitwise_not(x["score"]))
    ids = F.transform("own", lambda x: x["other_id"])
    windows = windows.select("row", scores.alias("scores"), ids.alias("positive_ids"))
    asked = anchors.join(windows, "row").withColumn("scores", F.filter("scores", lambda s: s >= 0)).filter("size(scores) > 0")
    least = F.array_min("scores") / 100.0 * low - 1
    most = F.array_max("scores") / 100.0 * high + 1
    asked = asked.withColumns({"least": F.floor(least), "most": F.ceil(most)})
    mined = _negatives_of(asked, blocks, trees, negatives, low, high)
    rank = F.row_number().over(Window.partitionBy("row", "positive").orderBy(F.col("negative_score").desc(), "negative_id"))
    mined = mined.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    names = windows.join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return mined.join(names, "row").select(
        "anchor_id",
        F.element_at("positive_ids", F.col("positive")).alias("positive_id"),
        "rank",
        "negative_id",
        F.element_at("scores", F.col("positive")).alias("positive_score"),
        "negative_score",
    )


def _trees(rows: DataFrame, fan: int, leaf: int) -> dict[int, Tree]:
    """A tree for every length of vector: split points from a sample, ranges from all rows."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    totals = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("most")).collect()
    trees = {}
    for total in totals:
        bound = max(2 * fan, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, total.dim))))
        own = rows.filter(F.col("dim") == total.dim).select("row", "v")
        # Row numbers are hashes: the lowest are a sample, and a bar keeps the rest out of the sort.
        share = min(1.0, 2 * bound / total.n)
        low_rows = own.filter(F.col("row") <= int(-(1 << 63) + share * ((1 << 64) - 1025)))
        sample = (low_rows.orderBy("row").limit(bound) if total.n > leaf else own.limit(1)).select("v").collect()
        points = np.array([r.v for r in sample], dtype=np.int64).reshape(len(sample), total.dim)
        trees[total.dim] = plant(points, total.n, float(total.most) * (1 + 1e-9) + 1, fan, leaf)
    ranges = rows.mapInArrow(_ranger(trees), _RANGES).groupBy("dim", "node", "i", "j")
    for r in ranges.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        node = trees[r.dim].nodes[r.node]
        node.low[r.i, r.j], node.high[r.i, r.j] = r.low, r.high
    return trees


_ANCHOR = "row long, id long, label int, v array<long>, dim int"
_ASKED = "dim int, leaf int, a_rows binary, a_ids binary, a_labels binary, a_vectors binary"


def _compare(anchors: DataFrame, blocks: DataFrame, trees: dict[int, Tree], home: bool, k: int) -> DataFrame:
    """The best rows of the same label among the leaves that anchors reach."""
    columns = ["row", "id", "label", "v", "dim", "least", "most", "leaf"]
    reaching = anchors.select(*columns).mapInArrow(
        _reaching(trees, home), f"{_ANCHOR}, least long, most long, leaf int"
    )
    asked = reaching.repartition("dim", "leaf").mapInArrow(_asker([]), _ASKED)
    found = asked.join(blocks, ["dim", "leaf"]).mapInArrow(_positives(k), _FOUND)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "other_id", "other_row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def _negatives_of(anchors: DataFrame, blocks: DataFrame, trees: dict[int, Tree], k: int, low: int, high: int) -> DataFrame:
    columns = ["row", "id", "label", "v", "dim", "least", "most", "scores", "leaf"]
    reaching = anchors.select(*columns).mapInArrow(
        _reaching(trees, False), f"{_ANCHOR}, least long, most long, scores array<long>, leaf int"
    )
    asked = reaching.repartition("dim", "leaf").mapInArrow(_asker(["scores"]), f"{_ASKED}, scores array<array<long>>")
    return asked.join(blocks, ["dim", "leaf"]).mapInArrow(_negatives(k, low, high), _MINED)
