"""Recipes from raw pages to analysed documents.

A recipe is a function ``(pages, templates, run_id, gather_time) -> documents``, and an analysis is
a function ``docs(id, content) -> frame keyed by id``. Both are the places for own code.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls, values
from corpusloom.operators import extraction, frontier, shop, template_admin, text_analysis
from corpusloom.schema import WEBPAGE
from corpusloom.session import broadcast_if_small, new_path
from corpusloom.sources import snapshots
from corpusloom.sources.sinks import Sink, fan_out
from corpusloom.sources.templates import with_template_columns

Recipe = Callable[[DataFrame, DataFrame, str, datetime], DataFrame]
Analysis = Callable[[DataFrame], DataFrame]


def general_recipe(pages: DataFrame, templates: DataFrame, run_id: str, gather_time: datetime) -> DataFrame:
    return extraction.collected(extraction.extract_documents(pages, templates, run_id, gather_time))


def shop_recipe(pages: DataFrame, templates: DataFrame, run_id: str, gather_time: datetime) -> DataFrame:
    """Product pages of the shops that have a template."""
    sites = with_template_columns(templates).select(
        F.col("domain").alias("site"),
        F.col("id").alias("template_id"),
        F.map_from_entries(values.last_by_name(F.col("staticFields"))).alias("static"),
    )
    matched = pages.withColumn("site", urls.host_of(F.col("url"))).join(broadcast_if_small(sites), "site")
    products = shop.product_fields(matched)
    docs = shop.product_documents(products, F.col("template_id"), F.col("site"), F.col("static"), run_id, gather_time)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in WEBPAGE.fields if f.name not in docs.columns}
    return docs.withColumns(missing).select(*WEBPAGE.names)


def analyse(
    docs: DataFrame,
    keywords: Analysis | None = text_analysis.keywords,
    summary: Analysis | None = text_analysis.summaries,
    entities: Analysis | None = None,
) -> DataFrame:
    """Fill ``keywords``, ``summary`` and ``namedEntity`` with the results of the given analyses."""
    texts = docs.select("id", "content")
    for column, analysis in (("keywords", keywords), ("summary", summary), ("namedEntity", entities)):
        if analysis is not None:
            docs = docs.drop(column).join(analysis(texts), "id", "left")
    return docs.select(*WEBPAGE.names)


def run(
    pages: DataFrame,
    templates: DataFrame,
    sinks: Sequence[Sink],
    run_id: str,
    gather_time: datetime,
    recipe: Recipe = general_recipe,
    analysis: Analysis | None = None,
    links: str | None = None,
) -> None:
    """One batch run: valid templates, then ``process``. Templates that break a rule are left out; they hurt
    no other site."""
    complete = with_template_columns(templates)
    valid = template_admin.validate(complete).filter(F.size("violations") == 0).drop("violations")
    process(pages, valid, sinks, run_id, gather_time, recipe, analysis, links)


def process(
    pages: DataFrame,
    templates: DataFrame,
    sinks: Sequence[Sink],
    run_id: str,
    gather_time: datetime,
    recipe: Recipe = general_recipe,
    analysis: Analysis | None = None,
    links: str | None = None,
) -> None:
    """Recipe, analysis and every sink, for pages and templates as they are.

    The extracted documents are written to the shared folder once, and the analysis and the sinks read
    them there. Only documents of templates with ``doNLP`` are analysed, and only these make up the
    statistics of the analysis. With ``links``, the links of the pages are appended to the table at that path.
    """
    if links:
        frontier.write_links(frontier.discover_links(extraction.match_templates(pages, templates), run_id), links)
    docs = stored_once(recipe(pages, templates, run_id, gather_time), "extracted")
    if analysis:
        wanted = with_template_columns(templates).filter("doNLP").select(F.col("id").alias("spiderInfoId")).distinct()
        side = broadcast_if_small(wanted)
        analysed = analysis(docs.join(side, "spiderInfoId", "left_semi").select(*docs.columns))
        others = docs.join(side, "spiderInfoId", "left_anti").select(*docs.columns)
        docs = stored_once(analysed.unionByName(others), "analysed")
    fan_out(docs, sinks)


def stored_once(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` written to the shared folder and read back, so that no later job works it out again."""
    path = new_path(docs.sparkSession, label)
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def update_stored(
    root: str,
    old_template_id: str,
    templates: DataFrame,
    new_template_id: str,
    run_id: str,
    gather_time: datetime,
) -> DataFrame:
    """Read the stored documents of one template again with another and merge them into a new snapshot."""
    spark = templates.sparkSession

    def step(store: DataFrame) -> DataFrame:
        return extraction.re_extracted_store(
            store, old_template_id, templates, new_template_id, run_id, gather_time
        )

    stored = snapshots.read_snapshot(spark, root)
    touched = stored.filter(F.col("spiderInfoId") == old_template_id).select("id")
    return snapshots.change(spark, root, step, touched)
