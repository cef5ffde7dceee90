"""Similar pages for every document of an index: a top-k join with upper bounds of scores.

A document's query are its most typical terms. Every term has a maximum weight over its postings, so the terms
that a pair has not been seen to share still bound its score. A first look, at the heaviest postings of each term or at a
sample of the documents, gives every query the score that a result has to reach. From then on

* the lightest terms of a query, which cannot reach it together, or are too few for a match, look nothing up;
* the others look up only postings that are heavy enough to reach it if all other terms were at their maximum.
  Postings lie in levels of weight, so lighter levels of a list are not even joined.

``lookups`` and ``candidates`` give these pairs as tables, for an index whose pairs have room on disk.

Pairs are neither written nor shuffled. Documents are dealt into blocks; a task holds the postings of a block, lets
the queries of all documents pass by, and makes rows only of a query's best of the block that reach that score. What is
shuffled is the postings once, the queries once for each block, and the results. In a block, the weights bound a score
once more: postings of the terms that can't reach it together are not looked at, if the others have few; otherwise the
block adds up its terms, those of many documents as whole rows. What is found is then scored from its postings. No
result is lost: what is left out is below the score to be reached. The work still grows with the square of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import search, text_analysis
from corpusloom.session import broadcast_if_small, giving_back

#: Heaviest postings of a term that the first look takes, for each wanted result.
CHAMPIONS = 4
#: Levels of weight within the postings of a term.
LEVELS = 16
#: Scores are rounded to six places, so a bound must miss by more than this to count.
SLACK = 2e-6
#: Postings that a task holds.
BLOCK_POSTINGS = 1 << 22
#: Queries that a task answers at once.
QUERIES = 256
#: A list of a block with a document in so many is also kept as a row, as far as the rows of a task have no more cells.
ROW_SHARE = 16
CELLS = 1 << 25
#: Up to so many postings of a query are put together by sorting, more by adding up rows.
LISTED = 400
#: Indexes of more postings than this take their first scores from one document in ``SAMPLED``.
SAMPLE_FROM = 1 << 21
SAMPLED = 16


def typical_of_all(index: search.TextIndex, most: int, min_doc_freq: int, min_match: float) -> DataFrame:
    """``seed_id, term, needed``: the query terms of every document, and how many of them a result must have."""
    n_docs = index.totals.select("n_docs").scalar()
    vectors = index.postings.select("id", "term", "tf")
    typical = search.typical_terms(vectors, index.terms, n_docs, False, None, most, min_doc_freq)
    number = F.count("*").over(Window.partitionBy("id"))
    return typical.select(
        F.col("id").alias("seed_id"), "term", F.greatest(F.floor(number * min_match), F.lit(1)).alias("needed")
    )


def posting_weights(index: search.TextIndex, wanted: DataFrame) -> DataFrame:
    """``term, id, part``: the weight of every posting of the wanted terms, as a stored table."""
    n_docs = index.totals.select("n_docs").scalar()
    mean_length = index.totals.select("mean_length").scalar()
    terms = index.terms.join(wanted.select("term").distinct(), "term", "left_semi").select("term", "df")
    part = search.bm25(F.col("tf"), F.col("df"), F.col("doc_length"), n_docs, mean_length)
    parts = index.postings.select("term", "id", "tf", "doc_length").join(broadcast_if_small(terms), "term")
    return text_analysis.stored(parts.select("term", "id", part.alias("part")), "weights")


def weighted_postings(index: search.TextIndex, wanted: DataFrame) -> DataFrame:
    """``term, id, part, most, level``: the weight of every posting of the wanted terms, and the largest of its term."""
    parts = posting_weights(index, wanted)
    largest = broadcast_if_small(parts.groupBy("term").agg(F.max("part").alias("most")))
    return parts.join(largest, "term").withColumn("level", _level(F.col("part"), F.col("most")))


def _level(part: Column, most: Column) -> Column:
    return F.least(F.floor(part / most * LEVELS), F.lit(LEVELS - 1)).cast("int")


def scores_to_reach(wanted: DataFrame, postings: DataFrame, size: int) -> DataFrame:
    """``seed_id, bar``: a score that ``size`` documents at least reach, or 0.

    It comes from the heaviest postings of each term or, with many postings, from a sample of the documents, whose
    scores are whole: few documents are the heaviest of several terms."""
    if postings.count() > SAMPLE_FROM:
        sampled = postings.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SAMPLED)) == 0)
        no_bars = wanted.select("seed_id", F.lit(0.0).alias("bar")).limit(0)
        ranked = best_of_blocks(wanted, sampled, no_bars, size, sliced=True)
    else:
        heaviest = Window.partitionBy("term").orderBy(F.col("part").desc(), "id")
        champions = postings.withColumn("turn", F.row_number().over(heaviest)).filter(F.col("turn") <= CHAMPIONS * size)
        seen = wanted.join(champions.select("term", "id", "part"), "term").filter("seed_id <> id")
        # What is seen of a score is less than all of it; enough terms must be seen for the document to count.
        seen = seen.groupBy("seed_id", "id").agg(
            F.sum("part").alias("score"), F.count("*").alias("n"), F.max("needed").alias("needed")
        )
        ranked = seen.filter("n >= needed")
    best = Window.partitionBy("seed_id").orderBy(F.col("score").desc())
    ranked = ranked.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= size)
    bar = F.when(F.count("*") >= size, F.min("score")).otherwise(0.0)
    return ranked.groupBy("seed_id").agg(bar.alias("bar"))


def lookups(wanted: DataFrame, postings: DataFrame, bars: DataFrame) -> DataFrame:
    """``seed_id, term, least, level``: the terms that look documents up, the weight a posting needs, and each level
    that has such weights."""
    largest = postings.select("term", "most").distinct()
    known = wanted.join(broadcast_if_small(largest), "term").join(bars, "seed_id", "left").fillna(0.0, ["bar"])
    of_seed = Window.partitionBy("seed_id")
    lightest = of_seed.orderBy("most", "term")
    known = known.withColumns(
        {
            "turn": F.row_number().over(lightest),
            "upto": F.sum("most").over(lightest.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "all": F.sum("most").over(of_seed),
        }
    )
    # The lightest terms together stay below the bar, or are fewer than a match needs.
    idle = (F.col("upto") < F.col("bar") - SLACK) | (F.col("turn") < F.col("needed"))
    least = F.col("bar") - SLACK - (F.col("all") - F.col("most"))
    looked = known.filter(~idle).withColumn("least", least).filter("least <= most")
    first = _level(F.greatest(F.col("least") - SLACK, F.lit(0.0)), F.col("most"))
    return looked.select("seed_id", "term", "least", F.explode(F.sequence(first, F.lit(LEVELS - 1))).alias("level"))


def candidates(looked: DataFrame, postings: DataFrame) -> DataFrame:
    """``seed_id, id``: the pairs that a lookup finds, each once."""
    found = looked.join(postings.select("term", "level", "id", "part"), ["term", "level"])
    return found.filter((F.col("part") >= F.col("least")) & (F.col("seed_id") != F.col("id"))).select("seed_id", "id").distinct()


class _Block:
    """The postings of some documents as lists by term, each sorted by id. Rows of one term and id count as one.

    The longest lists are also kept as rows with a place for every document, so that they are added up without looking
    a document up. These rows are rounded and only find candidates; results come from the lists."""

    def __init__(self, ids: pa.Array, terms: np.ndarray, parts: np.ndarray) -> None:
        coded = ids.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        self.ids = coded.dictionary.take(order)
        place = np.empty(len(order), dtype=np.int32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        docs = place[coded.indices.to_numpy()]
        turn = np.lexsort((docs, terms))
        terms, docs, parts = terms[turn], docs[turn], parts[turn]
        first = np.ones(len(terms), dtype=bool)
        first[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(first)
        self.docs, self.parts = docs[at], np.add.reduceat(parts, at)
        self.counts = np.diff(np.r_[at, len(terms)])
        self.once = len(at) == len(terms)
        self.terms, starts = np.unique(terms[at], return_index=True)
        self.starts = np.r_[starts, len(at)]
        self.most = np.maximum.reduceat(self.parts, starts)
        n, lengths = len(self.ids), np.diff(self.starts)
        self.cells = np.repeat(np.arange(len(lengths)) * n, lengths) + self.docs
        longest = np.argsort(-lengths, kind="stable")[: max(1, CELLS // n)]
        longest = longest[lengths[longest] * ROW_SHARE >= n]
        self.row = np.full(len(lengths), -1)
        self.row[longest] = np.arange(len(longest))
        self.rows = np.zeros((len(longest), n), dtype=np.float32)
        for row, one in zip(self.rows, longest):
            there = slice(self.starts[one], self.starts[one + 1])
            row[self.docs[there]] = self.parts[there]

    def scores(self, doc: np.ndarray, lists: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of matches of each of ``doc`` by ``number`` of the ``lists``, 1 at least, from ``first`` on."""
        begin = np.cumsum(number) - number
        one = lists[np.repeat(first - begin, number) + np.arange(number.sum())]
        wanted = one * len(self.ids) + np.repeat(doc, number)
        order = np.argsort(wanted)
        at = np.empty(len(wanted), dtype=np.int64)
        at[order] = np.minimum(np.searchsorted(self.cells, wanted[order]), len(self.cells) - 1)
        hit = self.cells[at] == wanted
        return np.add.reduceat(np.where(hit, self.parts[at], 0.0), begin), np.add.reduceat(np.where(hit, self.counts[at], 0), begin)

    def _by_lists(
        self, lists: np.ndarray, query: np.ndarray, bars: np.ndarray, lightest: np.ndarray, first: np.ndarray, idle: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, document, score)`` of the documents in ``lists`` that may reach the bar with the terms left out: ``idle``
        many of ``lightest``, from ``first`` on, by weight. These are followed from the heaviest one, as rows or bounds, so
        the score is a bound as well."""
        n = len(self.ids)
        lengths = self.starts[lists + 1] - self.starts[lists]
        at = np.repeat(self.starts[lists] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        cell = np.repeat(query * n, lengths) + self.docs[at]
        order = np.argsort(cell)
        cell = cell[order]
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        row, doc = np.divmod(cell[begin], n)
        score = np.add.reduceat(self.parts[at[order]], begin)
        most = self.most[lightest]
        upto = np.r_[0, np.cumsum(most)]
        low = bars - SLACK - SLACK * (1 + upto[first + idle] - upto[first])
        step = 0
        while True:
            left = idle[row] - step
            rest = upto[first[row] + left.clip(0)] - upto[first[row]]
            kept = score + rest >= low[row]
            row, doc, score, left = row[kept], doc[kept], score[kept], left[kept]
            if not (left > 0).any():
                return row, doc, score
            one = first[row] + (left - 1).clip(0)
            its = self.row[lightest[one]]
            more = np.where(its >= 0, self.rows.ravel()[its.clip(0) * n + doc], most[one]) if len(self.rows) else most[one]
            score += np.where(left > 0, more, 0)
            step += 1

    def _by_rows(self, lists: np.ndarray, needed: int, bar: float, own: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that may be among the best ``size`` of one query, and about their scores, from all of its lists."""
        row_of = self.row[lists]
        score = np.zeros(len(self.ids), dtype=np.float32)
        for row in row_of[row_of >= 0].tolist():
            score += self.rows[row]
        for one in lists[row_of < 0].tolist():
            there = slice(self.starts[one], self.starts[one + 1])
            score[self.docs[there]] += self.parts[there]
        if own >= 0:
            score[own] = 0
        rounding = SLACK * (1 + self.most[lists].sum())
        found = np.flatnonzero(score >= max(bar - SLACK - rounding, 1e-30))
        score = score[found]
        if len(found) <= 16 * size:
            return found, score
        # Without a good bar, the best that match give one.
        seen = size
        while True:
            seen = min(4 * seen, len(found))
            best = found[np.argpartition(score, len(found) - seen)[-seen:]]
            exact, matched = self.scores(best, lists, np.zeros(seen, dtype=np.int64), np.full(seen, len(lists)))
            best, exact = best[matched >= needed], exact[matched >= needed]
            if len(exact) >= size:
                kept = score >= np.partition(exact, len(exact) - size)[-size] - SLACK - rounding
                return found[kept], score[kept]
            if seen == len(found):
                return best, exact

    def best(self, lists: np.ndarray, query: np.ndarray, needed: np.ndarray, bars: np.ndarray, own: np.ndarray, size: int):
        """``(query, document, score)`` of the documents that may be among the best ``size`` of some queries.

        ``lists`` are those of their terms and ``query``, ascending, says whose; ``own`` is the document that is the query."""
        most = self.most[lists]
        order = np.lexsort((most, query))
        lists, most = lists[order], most[order]
        number = np.bincount(query, minlength=len(needed))
        first = np.cumsum(number) - number
        upto = np.cumsum(most)
        upto -= np.r_[0, upto][first[query]]
        # The lightest lists together stay below the bar, or are fewer than a match needs.
        idle = upto < bars[query] - SLACK
        if self.once:
            idle |= np.arange(len(lists)) - first[query] < needed[query] - 1
        total = np.bincount(query, weights=most, minlength=len(needed))
        left_out = np.bincount(query[idle], minlength=len(needed))
        work = np.bincount(query[~idle], weights=(self.starts[lists + 1] - self.starts[lists])[~idle], minlength=len(needed))
        by_rows = work > LISTED
        rows: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        about: list[np.ndarray] = []
        listed = ~idle & ~by_rows[query]
        if listed.any():
            row, doc, score = self._by_lists(lists[listed], query[listed], bars, lists, first, left_out)
            rows.append(row)
            docs.append(doc)
            about.append(score)
        for one in np.flatnonzero(by_rows).tolist():
            its = lists[first[one] : first[one] + number[one]]
            found, score = self._by_rows(its, needed[one], bars[one], own[one], size)
            rows.append(np.full(len(found), one))
            docs.append(found)
            about.append(score)
        row, doc = (np.concatenate([np.zeros(0, dtype=np.int64), *some]) for some in (rows, docs))
        most_of_all = np.concatenate([np.zeros(0), *about])
        kept = doc != own[row]
        row, doc, most_of_all = row[kept], doc[kept], most_of_all[kept]
        if not len(row):
            return row, doc, np.zeros(0)
        order = np.lexsort((-most_of_all, row))
        row, doc, most_of_all = row[order], doc[order], most_of_all[order]
        # The foremost of a query raise its bar, if they all match; the others of less are not scored.
        foremost = np.arange(len(row)) - np.searchsorted(row, row) < size
        score, matched = np.zeros(len(row)), np.zeros(len(row), dtype=np.int64)

        def scored(some: np.ndarray) -> None:
            if some.any():
                score[some], matched[some] = self.scores(doc[some], lists, first[row[some]], number[row[some]])

        scored(foremost)
        well = foremost & (matched >= needed[row])
        least = np.full(len(needed), np.inf)
        np.minimum.at(least, row[well], score[well])
        low = np.where(np.bincount(row[well], minlength=len(needed)) >= size, np.maximum(bars, least), bars)
        scored(~foremost & (most_of_all >= (low - SLACK - SLACK * (1 + total))[row]))
        kept = (matched >= needed[row]) & (score >= low[row] - SLACK)
        row, doc, score = row[kept], doc[kept], score[kept]
        order = np.lexsort((-score, row))
        row, doc, score = row[order], doc[order], score[order]
        first = np.searchsorted(row, np.arange(len(needed)))
        # What differs from the last place by the rounding only goes on: ties are settled by the rounded score.
        last = np.minimum(first + size, np.searchsorted(row, np.arange(len(needed)), side="right")) - 1
        kept = score >= score[last[row]] - SLACK
        return row[kept], doc[kept], score[kept]


def _block_scorer(size: int) -> Callable:
    """Rows come sorted by (block, kind): the postings of a block, then its queries."""

    def answers(block: _Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = batch.column(6).flatten().to_numpy(zero_copy_only=False)
        lists = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
        query = np.repeat(np.arange(len(batch)), batch.column(6).value_lengths().to_numpy(zero_copy_only=False))
        known = block.terms[lists] == terms
        own = pc.fill_null(pc.index_in(batch.column(2), value_set=block.ids), -1).to_numpy(zero_copy_only=False)
        bars, needed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        row, doc, score = block.best(lists[known], query[known], needed, bars, own, size)
        return pa.record_batch(
            [batch.column(2).take(pa.array(row)), block.ids.take(pa.array(doc)), pa.array(score)],
            names=["seed_id", "id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        ids: list[pa.Array] = []
        terms: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)]
            for first, last in zip(edges[:-1], edges[1:]):
                if last == first:
                    continue
                rows = batch.slice(first, last - first)
                if keys[first] >> 1 != key:
                    key, block, ids, terms, parts = keys[first] >> 1, None, [], [], []
                if keys[first] & 1 == 0:
                    ids.append(rows.column(2))
                    terms.append(rows.column(3).to_numpy(zero_copy_only=False).astype(np.int64))
                    parts.append(rows.column(4).to_numpy(zero_copy_only=False))
                elif block or ids:
                    if block is None:
                        block = _Block(pa.concat_arrays(ids), np.concatenate(terms), np.concatenate(parts))
                        ids, terms, parts = [], [], []
                    for at in range(0, len(rows), QUERIES):
                        yield answers(block, rows.slice(at, QUERIES))

    return run


def best_of_blocks(wanted: DataFrame, postings: DataFrame, bars: DataFrame, size: int, sliced: bool = False) -> DataFrame:
    """``seed_id, id, score``: of every block of documents the best ``size`` of every query, and those that are
    as good but for the rounding. A term that a query has twice counts twice.

    ``sliced`` deals the queries, not the documents, over tasks where there are fewer blocks than that: for few postings."""
    tasks = 2 * postings.sparkSession.sparkContext.defaultParallelism
    blocks = max(1 if sliced else tasks, -(-postings.count() // BLOCK_POSTINGS))
    slices = -(-tasks // blocks)
    id_type = postings.schema["id"].dataType

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt_by(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n))

    task = (F.col("of_id") * slices + F.col("of_seed")).cast("int").alias("block")
    lists = postings.filter("id is not null").select("term", "id", "part", dealt_by("id", blocks).alias("of_id"), every(slices).alias("of_seed"))
    lists = lists.select(
        task, F.lit(0).alias("kind"), "id", F.xxhash64("term").alias("term"), "part",
        F.lit(0).cast("long").alias("needed"), F.array().cast("array<long>").alias("terms"),
    )
    queries = wanted.filter("seed_id is not null").groupBy("seed_id").agg(
        F.collect_list(F.xxhash64("term")).alias("terms"), F.max("needed").cast("long").alias("needed")
    )
    queries = queries.join(bars, "seed_id", "left").fillna(0.0, ["bar"])
    queries = queries.select("*", every(blocks).alias("of_id"), dealt_by("seed_id", slices).alias("of_seed")).select(
        task, F.lit(1).alias("kind"), F.col("seed_id").alias("id"), F.lit(0).cast("long").alias("term"),
        F.col("bar").alias("part"), "needed", "terms",
    )
    both = lists.unionByName(queries).repartitionById(blocks * slices, "block").sortWithinPartitions("block", "kind")
    schema = T.StructType(
        [T.StructField("seed_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())]
    )
    return both.mapInArrow(giving_back(_block_scorer(size)), schema)


def similar_pages(
    index: search.TextIndex,
    size: int,
    most_terms: int = search.MLT_TERMS,
    min_doc_freq: int = search.MLT_MIN_DOC_FREQ,
    min_match: float = search.MLT_MIN_MATCH,
) -> DataFrame:
    """``seed_id, id, score, position``: the ``size`` most similar documents of every document of ``index``.

    Scores and conditions are those of ``search.more_like_this``; ties go to the smaller id. A document without
    typical terms has no results.
    """
    wanted = text_analysis.stored(typical_of_all(index, most_terms, min_doc_freq, min_match), "typical")
    postings = posting_weights(index, wanted)
    bars = text_analysis.stored(scores_to_reach(wanted, postings, size), "bars")
    found = best_of_blocks(wanted, postings, bars, size)
    scored = found.select("seed_id", "id", F.round("score", 6).alias("score"))
    best = Window.partitionBy("seed_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= size)
