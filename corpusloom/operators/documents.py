"""Looking at the document store: filters, pages and counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def page_of(df: DataFrame, order: Sequence[Column], size: int, page: int) -> DataFrame:
    """Page ``page`` (from 1) of ``df``. Planned as a top-k per partition, not as a global sort."""
    if size < 0 or page < 1:
        raise ValueError("size must not be negative and pages count from 1")
    return df.orderBy(*order).offset(size * (page - 1)).limit(size)


def _newest_first() -> list[Column]:
    """Newest first; the id makes the order total."""
    return [F.col("gatherTime").desc(), F.col("id")]


def of_run(docs: DataFrame, run_id: str, size: int, page: int) -> DataFrame:
    return page_of(docs.filter(F.col("spiderUUID") == run_id), [F.col("id")], size, page)


def of_domain(docs: DataFrame, domain: str, size: int, page: int) -> DataFrame:
    return page_of(docs.filter(F.col("domain") == domain), _newest_first(), size, page)


def of_domains(docs: DataFrame, domains: Sequence[str], size: int, page: int) -> DataFrame:
    """Documents of any of the domains; none for an empty list."""
    wanted = F.col("domain").isin(*domains) if domains else F.lit(False)
    return page_of(docs.filter(wanted), _newest_first(), size, page)


def by_id(docs: DataFrame, doc_id: object) -> DataFrame:
    """The document with this id; an error if there is none."""
    found = docs.filter(F.col("id") == doc_id)
    if found.isEmpty():
        raise LookupError(f"no document with id {doc_id!r}")
    return found


def newest(docs: DataFrame, size: int, page: int) -> DataFrame:
    return page_of(docs, _newest_first(), size, page)


def browse(
    docs: DataFrame, matches: Column | None = None, domain: str | None = None, page: int = 1, size: int = 10
) -> DataFrame:
    """One view for three questions: by search condition, else by domain, else everything."""
    if matches is not None:
        return newest(docs.filter(matches), size, page)
    if domain:
        return of_domain(docs, domain, size, page)
    return newest(docs, size, page)


def count_all(docs: DataFrame, condition: Column | None = None) -> DataFrame:
    kept = docs if condition is None else docs.filter(condition)
    return kept.agg(F.count("*").alias("n"))


def exists_where(df: DataFrame, condition: Column) -> bool:
    return not df.filter(condition).isEmpty()


def scroll(docs: DataFrame, condition: Column | None = None) -> Iterator[Row]:
    """A cursor on the driver that holds one partition at a time. Jobs should scan the frame instead."""
    return (docs if condition is None else docs.filter(condition)).toLocalIterator()


def page_with_total(df: DataFrame, order: Sequence[Column], size: int, page: int) -> DataFrame:
    """A page whose rows also carry the number of rows of the whole frame."""
    total = df.agg(F.count("*").alias("total"))
    return page_of(df, order, size, page).withColumn("total", total.scalar())


def find_one(df: DataFrame, condition: Column, order: Sequence[Column]) -> DataFrame:
    return df.filter(condition).orderBy(*order).limit(1)
