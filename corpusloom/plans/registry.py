"""All registered queries and their SQL checks, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import aggregates, extraction
from corpusloom.plans import (
    fixtures,
    queries_browse,
    queries_collect,
    queries_extraction,
    queries_links,
    queries_rollups,
    queries_search,
    queries_shop,
    queries_stores,
    queries_streams,
    queries_templates,
    queries_text,
)
from corpusloom.session import ship_package

_GROUPS = (
    queries_stores,
    queries_browse,
    queries_templates,
    queries_links,
    queries_extraction,
    queries_shop,
    queries_text,
    queries_search,
    queries_rollups,
    queries_streams,
    queries_collect,
)

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    """The query, run only once the workers have this package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for group in _GROUPS for name, query in group.QUERIES.items()}
CHECKS = {name: sql for group in _GROUPS for name, sql in group.CHECKS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    extracted = extraction.extract_documents(
        fixtures.pages(spark, sf_dir), fixtures.templates(spark, sf_dir), fixtures.RUN, fixtures.GATHERED
    )
    return aggregates.docs_per_domain(extraction.collected(extracted))
