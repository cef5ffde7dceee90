"""Source divergence audit: how far the term frequencies of the sources of a language lie apart.

Every group, a source within a language, gives each kept term a share; two groups are compared by a sum over
all kept terms. Most terms of a group pair are missing on at least one side, where the share is the group's
baseline, that of a term with no occurrence. The sums are therefore formed as a sparse matrix times its
transpose, row by row: the rows are groups, the term-major index holds for each term the groups that have it,
and a row scatters its terms through the index into one dense accumulator with a place for every peer. What
is added for a shared term is the difference from what the baselines give it; the baselines themselves are
added once per pair, from the number of terms a group has of each count. No row per pair of postings exists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, prepare
from corpusloom.session import broadcast_if_small

#: Shares are counted in this unit; each count is raised by this much.
UNIT = 1_000_000_000
RAISED = 2
#: Documents of its language that a kept term is in, and terms that are listed for each group.
LEAST_DOCUMENTS = 10
LISTED = 10

#: Characters of a text worked on at once; counts held by a task, and postings scattered at once.
_PIECE = 1 << 20
_HELD = 1 << 18
_POSTINGS = 1 << 20

#: A term is a run of ASCII letters and of characters beyond ASCII, whose UTF-8 bytes are all beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^A-Za-z\x80-\xff]")

_COUNTS = "lang string, term string, sources array<string>, n array<long>, docs array<long>"
_SUMS = "lang string, a int, b int, value long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time; pieces end between terms."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        yield _TERM.findall(text[at:end].lower())
        at = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term, by source, summed up inside a task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        counts = [x[0] for x in held.values()]
        width = [len(x) for x in counts]
        terms = pa.array((t for x in counts for t in x), type=pa.binary(), size=sum(width)).view(pa.string())
        flat = pa.table(
            {
                "lang": pa.array([k[0] for k in held]).take(np.repeat(np.arange(len(held)), width)),
                "term": terms,
                "sources": pa.array([k[1] for k in held]).take(np.repeat(np.arange(len(held)), width)),
                "n": pa.array((n for x in counts for n in x.values()), type=pa.int64(), size=sum(width)),
                "docs": pa.array((d[t] for x, d in held.values() for t in x), type=pa.int64(), size=sum(width)),
            }
        )
        lists = flat.group_by(["lang", "term"]).aggregate([(c, "list") for c in ("sources", "n", "docs")])
        held.clear()
        lists = lists.rename_columns(["lang", "term", "sources", "n", "docs"]).combine_chunks()
        return lists.to_batches()[0]

    size = 0
    for batch in batches:
        for text, lang, source in zip(*(column.to_pylist() for column in batch.columns)):
            counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(counts), set()
            for piece in terms_of(text):
                counts.update(piece)
                own.update(piece)
            documents.update(own)
            size += len(counts) - before
            if size >= _HELD:
                yield flush()
                size = 0
    if size:
        yield flush()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total), exactly, by long division in steps of a thousand."""
    rest, found = counts + RAISED, np.zeros(np.broadcast(counts, total).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))"""
    return (p - q) * (p - q) // (p + q)


def scatter_rows(term_of: np.ndarray, group_of: np.ndarray, count: np.ndarray, total: np.ndarray):
    """For each group ``a`` the peers ``b > a`` it shares terms with, and what shared terms add to the baselines.

    The postings of some terms of one language; ``total`` is the whole of the group of each posting.
    """
    by_term = np.argsort(term_of, kind="stable")
    term_of, group_of, count, total = term_of[by_term], group_of[by_term], count[by_term], total[by_term]
    share, base = shares(count, total), shares(np.zeros_like(count), total)
    terms, first, at = np.unique(term_of, return_index=True, return_inverse=True)
    last = np.append(first[1:], len(term_of))
    peers = int(group_of.max(initial=-1)) + 1
    by_group = np.argsort(group_of, kind="stable")
    groups, row_first = np.unique(group_of[by_group], return_index=True)
    row_last = np.append(row_first[1:], len(group_of))
    for a, lo, hi in zip(groups, row_first, row_last):
        row = by_group[lo:hi]
        accumulator = np.zeros(peers, dtype=np.int64)
        for part in np.array_split(row, max(1, len(row) * peers // _POSTINGS)):
            width = last[at[part]] - first[at[part]]
            mine = np.repeat(part, width)
            theirs = np.arange(len(mine)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[at[part]], width)
            wanted = group_of[theirs] > a
            mine, theirs = mine[wanted], theirs[wanted]
            added = distance(share[mine], share[theirs]) - distance(share[mine], base[theirs])
            added += distance(base[mine], base[theirs]) - distance(base[mine], share[theirs])
            np.add.at(accumulator, group_of[theirs], added)
        found = np.flatnonzero(accumulator)
        yield int(a), found, accumulator[found]


def _sums(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(value)), pa.array(a, type=pa.int32()), pa.array(b, type=pa.int32())]
    return pa.record_batch([*columns, pa.array(value, type=pa.int64())], names=["lang", "a", "b", "value"])


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the shared terms of a task's part of the index."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, lists in held.items():
            term_of = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
            columns = [np.concatenate([x[k] for x in lists]) for k in range(3)]
            for a, found, value in scatter_rows(term_of, *columns):
                if len(found):
                    yield _sums(lang, np.full(len(found), a), found, value)
        held.clear()

    for batch in batches:
        for lang, postings in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts = postings.values
            held.setdefault(lang, []).append(
                [parts.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("g", "n", "total")]
            )
            size += len(parts)
            if size >= _POSTINGS:
                yield from flush()
                size = 0
    yield from flush()


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every group what its own terms add against the baseline of each peer, and, once per pair, what all
    terms that neither has add."""
    for batch in batches:
        for row in batch.to_pylist():
            g, kept, total = row["g"], row["kept"], row["total"]
            peers = [x for x in row["peers"] if x["g"] != g]
            if not peers:
                continue
            other = np.array([x["g"] for x in peers], dtype=np.int64)
            value = np.zeros(len(peers), dtype=np.int64)
            if kept:
                theirs = np.array([x["total"] for x in peers], dtype=np.int64)
                base = shares(np.zeros_like(theirs), theirs)
                for x in row["spread"] or []:
                    value += x["terms"] * distance(shares(np.int64(x["n"]), np.int64(total)), base)
                # A shared term is taken off twice here; the accumulator gives it back once.
                neither = kept - row["own"] - np.array([x["own"] for x in peers], dtype=np.int64)
                both = neither * distance(shares(np.int64(0), np.int64(total)), base)
                value += np.where(other > g, both, 0)
            yield _sums(row["lang"], np.minimum(other, g), np.maximum(other, g), value)


def _share(n: Column, total: Column) -> Column:
    return F.expr("1L") + F.call_function("div", (n + RAISED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has for each source of a language all other
    sources of it by falling distance, part ``term`` the (at most ten) terms that the source uses most above its
    language.

    Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased; a language keeps those in at
    least ten of its rows. Shares are whole numbers, 1 + floor(10^9 * (count + 2) / (N + 2 * V)), and the distance of
    two is floor((p - q)^2 / (p + q)); all arithmetic is exact for fewer than 9 * 10^15 occurrences in a language.
    Null language, source and text count as empty. A group without kept terms is compared too; a language
    without kept terms gives distances of 0; one with a single source gives no pair. Ties go to the item that
    comes first in UTF-8. Rows that are repeated count as often as they come, a text of any length is cut into
    pieces between terms, an empty table gives an empty result, and other columns are not looked at.

    The groups of one language are taken as few enough to list every pair of them, which is the result.
    """
    spark = docs.sparkSession
    prepare(spark)
    cut = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c_) for c, c_ in ((text, "text"), (lang, "lang"), (source, "source"))])
    counted = cut.withColumn("text", F.col("text").cast("binary")).mapInArrow(_count_terms, _COUNTS)
    # One exchange by term serves the number of documents and the sums per group: the term-major index.
    docs_here = F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + x)
    listed = counted.withColumn("own", docs_here).repartition("lang", "term").groupBy("lang", "term").agg(
        F.sum("own").alias("docs"), F.flatten(F.collect_list(F.arrays_zip("sources", "n"))).alias("parts")
    )
    parts = listed.filter(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", F.inline("parts"))
    summed = parts.groupBy("lang", "term", F.col("sources").alias("source")).agg(F.sum("n").alias("n"))
    listed = summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("postings"))
    listed = materialise(listed, "divergence-terms")

    postings = listed.select("lang", "term", F.inline("postings"))
    kept = listed.groupBy("lang").agg(F.count("*").alias("kept"))
    spread = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    spread = spread.groupBy("lang", "source").agg(
        F.sum(F.col("n") * F.col("terms")).alias("occurrences"),
        F.sum("terms").alias("own"),
        F.collect_list(F.struct("n", "terms")).alias("spread"),
    )
    groups = cut.select("lang", "source").distinct().join(spread, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.fillna(0, ["occurrences", "own", "kept"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("g", F.row_number().over(by_lang.orderBy("source")) - 1)
    groups = groups.withColumn("whole", F.sum("occurrences").over(by_lang) + F.col("kept") * RAISED)
    groups = groups.withColumn("total", F.col("occurrences") + F.col("kept") * RAISED)
    groups = materialise(groups, "divergence-groups")

    numbered = broadcast_if_small(groups.select("lang", "source", "g", "total", "whole"))
    placed = postings.join(numbered, ["lang", "source"])
    index = placed.groupBy("lang", "term").agg(
        F.collect_list(F.struct("g", "n", "total")).alias("postings"),
        F.sum("n").alias("n"),
        F.first("whole").alias("whole"),
    )
    index = materialise(index, "divergence-index")

    shared = index.select("lang", "postings").mapInArrow(_accumulate, _SUMS)
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("g", "total", "own")).alias("peers"))
    apart = groups.select("lang", "g", "kept", "total", "own", "spread").join(peers, "lang")
    sums = shared.union(apart.mapInArrow(_baselines, _SUMS)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("other")),
                             F.struct(F.col("b").alias("g"), F.col("a").alias("other"))))
    names = groups.select("lang", "g", "source")
    pairs = (
        sums.select("lang", "value", both.alias("x"))
        .select("lang", "value", "x.g", "x.other")
        .join(broadcast_if_small(names), ["lang", "g"])
        .join(broadcast_if_small(names.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))), ["lang", "other"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    pairs = pairs.withColumn("rank", _rank())

    above = index.select("lang", "term", F.col("n").alias("all_n"), "whole", F.inline("postings"))
    p, q = _share(F.col("n"), F.col("total")), _share(F.col("all_n"), F.col("whole"))
    above = above.select("lang", "g", "term", p.alias("p"), q.alias("q")).filter("p > q")
    value = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    above = above.join(broadcast_if_small(names), ["lang", "g"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")
    )
    above = above.withColumn("rank", _rank()).filter(F.col("rank") <= LISTED)
    return pairs.union(above)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
