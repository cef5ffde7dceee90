"""Counts, histograms and facets over the document store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.operators.documents import newest
from corpusloom.operators.text_analysis import plain_content

DOMAINS = 50
WORDS = 200
FACET_SIZE = 10


def _top_keys(counts: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` most frequent keys, then without those of one character: fewer rows may remain."""
    return (
        counts.orderBy(F.col("n_docs").desc(), F.col(key)).limit(size).filter(F.length(key) > 1)
    )


def docs_per_domain(docs: DataFrame, size: int = DOMAINS) -> DataFrame:
    counts = docs.filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.count("*").alias("n_docs"))
    return _top_keys(counts, "domain", size)


def words_of_domain(docs: DataFrame, domain: str, size: int = WORDS) -> DataFrame:
    """Words of a domain by the number of documents that contain them."""
    words = F.array_distinct(tokens.tokens(plain_content(F.col("content"))))
    counts = (
        docs.filter(F.col("domain") == domain)
        .select(F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n_docs"))
    )
    return _top_keys(counts, "word", size)


def daily_histogram(docs: DataFrame, domain: str) -> DataFrame:
    """Documents of a domain per UTC day, newest first; days between without documents count 0.

    The calendar is made from the counts, whose shuffle Spark reuses for both sides.
    """
    counts = (
        docs.filter(F.col("domain") == domain)
        .groupBy(F.to_date("gatherTime").alias("day"))
        .agg(F.count("*").alias("n_docs"))
        .filter(F.col("day").isNotNull())
    )
    calendar = counts.agg(F.min("day").alias("first"), F.max("day").alias("last")).select(
        F.explode(F.expr("sequence(first, last, interval 1 day)")).alias("day")
    )
    return (
        calendar.join(counts, "day", "left")
        .select("day", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
        .orderBy(F.col("day").desc())
    )


def related_facets(docs: DataFrame, condition: Column, size: int = FACET_SIZE) -> DataFrame:
    """The most frequent people, places, organisations and keywords of the documents found.

    ``facet, key, n_docs``. The four facets are counted in one pass and one shuffle.
    """
    facets = {
        "relatedPeople": "namedEntity.nr",
        "relatedLocation": "namedEntity.ns",
        "relatedInstitution": "namedEntity.nt",
        "relatedKeywords": "keywords",
    }
    listed = F.array(
        *(F.struct(F.lit(name).alias("facet"), F.array_distinct(F.col(c)).alias("keys")) for name, c in facets.items())
    )
    counts = (
        docs.filter(condition)
        .select(F.explode(listed).alias("f"))
        .select("f.facet", F.explode("f.keys").alias("key"))
        .groupBy("facet", "key")
        .agg(F.count("*").alias("n_docs"))
    )
    best = Window.partitionBy("facet").orderBy(F.col("n_docs").desc(), F.col("key"))
    return (
        counts.withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= size)
        .drop("position")
    )


def related_documents(docs: DataFrame, condition: Column, size: int) -> DataFrame:
    """The other half of the facet view: the newest documents found."""
    return newest(docs.filter(condition), size, 1)
