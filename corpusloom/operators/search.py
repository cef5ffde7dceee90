"""Ranked search, field conditions and similar pages over an inverted index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.operators import text_analysis
from corpusloom.operators.documents import page_of
from corpusloom.session import broadcast_if_small, is_small

BM25_K1 = 1.2
BM25_B = 0.75
MLT_TERMS = 12
MLT_MIN_DOC_FREQ = 5
MLT_MIN_MATCH = 0.3
#: Up to this many seeds, their query terms (twelve each) are broadcast.
MLT_FEW_SEEDS = 10_000
INDEX_BUCKETS = 64
INDEX_FILE_ROWS = 4_000_000


@dataclass(frozen=True)
class TextIndex:
    """``postings(term, id, tf, doc_length)``, ``terms(term, df, cf)``, ``totals(n_docs, mean_length)``.

    Postings carry the document length, so that scoring needs no join by document.
    """

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def build_index(docs: DataFrame, only: Sequence[str] | None = None) -> TextIndex:
    """Index of ``id, content``; ``only`` restricts the postings to a few terms, not the totals.

    The texts are cut once: all postings are stored, and the lengths add up from them.
    """
    if only is not None:
        postings = text_analysis.term_vectors(docs, list(only))
        length = F.size(tokens.tokens(text_analysis.plain_content(F.col("content"))))
        totals = docs.agg(F.count("*").alias("n_docs"), F.avg(length).alias("mean_length"))
        return TextIndex(postings, text_analysis.term_statistics(postings), totals)
    postings = text_analysis.stored(text_analysis.term_vectors(docs), "postings")
    counted = docs.agg(F.count("*").alias("n_docs"), F.count("content").alias("n_texts"))
    all_tokens = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    totals = counted.crossJoin(all_tokens).select("n_docs", F.try_divide("n_tokens", "n_texts").alias("mean_length"))
    return TextIndex(postings, text_analysis.term_statistics(postings), totals)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(
    index: TextIndex, path: str, buckets: int = INDEX_BUCKETS, rows_per_file: int = INDEX_FILE_ROWS
) -> None:
    """Postings in one folder per term bucket, sorted by term, so that a query opens few row groups.

    Postings are counted, and dealt by ranges of (bucket, term, id) into as many
    files as their number asks for; a term of every document fills several.
    """

    def placed(table: DataFrame, name: str, *order: str) -> DataFrame:
        files = max(1, -(-table.count() // rows_per_file))
        by_bucket = table.withColumn("bucket", _bucket(F.col("term"), buckets))
        ranged = by_bucket.repartitionByRange(files, "bucket", *order).sortWithinPartitions("bucket", *order)
        ranged.write.partitionBy("bucket").parquet(f"{path}/{name}")
        return table.sparkSession.read.parquet(f"{path}/{name}")

    postings = placed(index.postings, "postings", "term", "id")
    placed(text_analysis.stored(text_analysis.term_statistics(postings), "terms"), "terms", "term")
    index.totals.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    """The stored index. Query functions add the bucket condition that prunes its folders."""
    return TextIndex(
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/totals"),
    )


def _of_terms(table: DataFrame, terms: Sequence[str], totals: DataFrame) -> DataFrame:
    wanted = F.col("term").isin(*terms) if terms else F.lit(False)
    if "bucket" in table.columns and terms:
        buckets = totals.first()["buckets"]
        spark = table.sparkSession
        rows = spark.createDataFrame([(t,) for t in terms], "term string")
        numbers = [r[0] for r in rows.select(_bucket(F.col("term"), buckets)).distinct().collect()]
        wanted = F.col("bucket").isin(*numbers) & wanted
    return table.filter(wanted)


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """The distinct tokens of a query text, cut as documents are."""
    row = spark.range(1).select(F.array_distinct(tokens.tokens(F.lit(text))).alias("t")).first()
    return list(row["t"])


def bm25(tf: Column, df: Column, doc_length: Column, n_docs: Column, mean_length: Column) -> Column:
    rarity = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    norm = BM25_K1 * (1 - BM25_B + BM25_B * doc_length / mean_length)
    return rarity * tf * (BM25_K1 + 1) / (tf + norm)


def score_documents(index: TextIndex, terms: Sequence[str]) -> DataFrame:
    """``id, score, n_matched`` of every document with at least one of the terms.

    The joined side has one row per query term; the sum is partial before its shuffle.
    """
    n_docs = index.totals.select("n_docs").scalar()
    mean_length = index.totals.select("mean_length").scalar()
    postings = _of_terms(index.postings, terms, index.totals).select("id", "term", "tf", "doc_length")
    frequencies = _of_terms(index.terms, terms, index.totals).select("term", "df")
    scored = postings.join(F.broadcast(frequencies), "term").select(
        "id", bm25(F.col("tf"), F.col("df"), F.col("doc_length"), n_docs, mean_length).alias("part")
    )
    return scored.groupBy("id").agg(
        F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("n_matched")
    )


def search(index: TextIndex, query: str, size: int, page: int) -> DataFrame:
    """Documents with any token of the query, best first: ``id, score``."""
    terms = query_terms(index.postings.sparkSession, query)
    scored = score_documents(index, terms).select("id", "score")
    return page_of(scored, [F.col("score").desc(), F.col("id")], size, page)


@dataclass(frozen=True)
class Clause:
    """One condition of a field search.

    ``op``: ``is`` (equal, or contained in a list field), ``match`` (any token of ``value`` in a
    text field), ``from`` and ``to`` (inclusive bounds). ``need``: ``must``, ``should`` or ``not``.
    A dynamic field is named ``dynamic_fields.<name>``.
    """

    field: str
    op: str
    value: object
    need: str = "must"


_TEXT_FIELDS = ("content", "title", "category", "summary")


def _clause_terms(spark: SparkSession, clauses: Sequence[Clause]) -> dict[str, list[str]]:
    """The tokens of every text to match, by one small job."""
    texts = sorted({str(c.value) for c in clauses if c.op == "match"})
    if not texts:
        return {}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    cut = rows.select("text", F.array_distinct(tokens.tokens(F.col("text"))).alias("terms"))
    return {r["text"]: list(r["terms"]) for r in cut.collect()}


def _clause_condition(docs: DataFrame, clause: Clause, terms: dict[str, list[str]]) -> Column:
    name, _, key = clause.field.partition(".")
    column = F.col(name)[key] if name == "dynamic_fields" and key else F.col(name)
    is_list = docs.schema[name].dataType.typeName() == "array"
    if clause.op == "is":
        return F.array_contains(column, clause.value) if is_list else column == F.lit(clause.value)
    if clause.op == "match":
        if name not in _TEXT_FIELDS and name != "dynamic_fields":
            raise ValueError(f"field {name!r} holds exact values; use op 'is'")
        text = F.array_join(column, " ") if is_list else column
        wanted = F.array(*(F.lit(t) for t in terms[str(clause.value)])).cast("array<string>")
        return F.arrays_overlap(tokens.tokens(text_analysis.plain_content(text)), wanted)
    if clause.op == "from":
        return column >= F.lit(clause.value).cast(docs.schema[name].dataType)
    if clause.op == "to":
        return column <= F.lit(clause.value).cast(docs.schema[name].dataType)
    raise ValueError(f"unknown op {clause.op!r}")


def _conditions(docs: DataFrame, clauses: Sequence[Clause]) -> dict[str, list[Column]]:
    terms = _clause_terms(docs.sparkSession, clauses)
    groups: dict[str, list[Column]] = {"must": [], "should": [], "not": []}
    for clause in clauses:
        groups[clause.need].append(F.coalesce(_clause_condition(docs, clause, terms), F.lit(False)))
    return groups


def matching(docs: DataFrame, clauses: Sequence[Clause]) -> Column:
    """All ``must`` clauses hold, no ``not`` clause does, and without a ``must`` some ``should`` does."""
    return _all_hold(_conditions(docs, clauses))


def _all_hold(groups: dict[str, list[Column]]) -> Column:
    condition = F.lit(True)
    for must in groups["must"]:
        condition = condition & must
    for unwanted in groups["not"]:
        condition = condition & ~unwanted
    if groups["should"] and not groups["must"]:
        condition = condition & reduce(or_, groups["should"])
    return condition


def search_fields(docs: DataFrame, clauses: Sequence[Clause], size: int, page: int) -> DataFrame:
    """Documents that meet the clauses; more ``should`` clauses met first, then newest."""
    groups = _conditions(docs, clauses)
    met = reduce(add, (c.cast("int") for c in groups["should"]), F.lit(0))
    found = docs.filter(_all_hold(groups)).withColumn("n_should", met)
    return page_of(found, [F.col("n_should").desc(), F.col("gatherTime").desc(), F.col("id")], size, page)


def typical_terms(
    vectors: DataFrame,
    terms: DataFrame,
    n_docs: Column,
    few: bool = True,
    buckets: int | None = None,
    most: int = MLT_TERMS,
    min_doc_freq: int = MLT_MIN_DOC_FREQ,
) -> DataFrame:
    """The query terms of seed documents: ``id, term, df, score``.

    ``vectors`` holds the terms of the seeds, ``few`` says that their number has been checked. Terms of fewer
    than ``min_doc_freq`` documents are of no use. Of stored terms in ``buckets`` only the folders of the
    seeds' terms are read.
    """
    weight = F.col("tf") * (F.log((n_docs + 1) / (F.col("df") + 1)) + 1)
    frequencies = terms.select("term", "df")
    if few and buckets:
        placed = vectors.withColumn("bucket", _bucket(F.col("term"), buckets))
        joined = terms.select("bucket", "term", "df").join(broadcast_if_small(placed), ["bucket", "term"])
    elif few:
        joined = vectors.join(frequencies, "term")
    else:
        joined = text_analysis.join_on_term(vectors, frequencies, "id")
    scored = joined.filter(F.col("df") >= min_doc_freq).withColumn("score", F.round(weight, 6))
    return text_analysis.top_terms(scored, most, "df")


def more_like_this(
    index: TextIndex,
    seeds: DataFrame,
    size: int,
    page: int = 1,
    most_terms: int = MLT_TERMS,
    min_doc_freq: int = MLT_MIN_DOC_FREQ,
    min_match: float = MLT_MIN_MATCH,
) -> DataFrame:
    """Similar documents of each seed document: ``seed_id, id, score, position``.

    ``seeds`` has ``id, content``; a page view asks for one seed, a job may ask for many. A result
    has at least ``min_match`` of the seed's query terms. The work is the postings of those terms, so it
    grows with the number of seeds; it is not meant for every pair of documents.
    """
    if page < 1:
        raise ValueError("pages count from 1")
    n_docs = index.totals.select("n_docs").scalar()
    mean_length = index.totals.select("mean_length").scalar()
    few = is_small(seeds.select("id"), max_rows=MLT_FEW_SEEDS)
    buckets = index.totals.first()["buckets"] if "bucket" in index.postings.columns else None
    wanted = typical_terms(
        text_analysis.term_vectors(seeds), index.terms, n_docs, few, buckets, most_terms, min_doc_freq
    )
    of_seed = Window.partitionBy("seed_id")
    wanted = wanted.select(F.col("id").alias("seed_id"), "term", "df").withColumn(
        "needed", F.greatest(F.floor(F.count("*").over(of_seed) * min_match), F.lit(1))
    )
    postings = index.postings.select("term", "id", "tf", "doc_length")
    if few and buckets:
        # The bucket is a folder: joining on it lets Spark read only the folders of these terms.
        wanted = wanted.withColumn("bucket", _bucket(F.col("term"), buckets))
        hits = index.postings.join(F.broadcast(wanted), ["bucket", "term"])
    elif few:
        hits = postings.join(F.broadcast(wanted), "term")
    else:
        hits = text_analysis.join_on_term(postings, wanted, "id")
    part = bm25(F.col("tf"), F.col("df"), F.col("doc_length"), n_docs, mean_length)
    scored = (
        hits.filter(F.col("id") != F.col("seed_id"))
        .groupBy("seed_id", "id")
        .agg(
            F.round(F.sum(part), 6).alias("score"),
            F.count("*").alias("n_matched"),
            F.max("needed").alias("needed"),
        )
        .filter(F.col("n_matched") >= F.col("needed"))
    )
    best = Window.partitionBy("seed_id").orderBy(F.col("score").desc(), F.col("id"))
    first = size * (page - 1)
    return (
        scored.withColumn("position", F.row_number().over(best))
        .filter((F.col("position") > first) & (F.col("position") <= first + size))
        .select("seed_id", "id", "score", "position")
    )
