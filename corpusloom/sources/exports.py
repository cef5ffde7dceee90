"""Text exports of the document store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_export(docs: DataFrame, condition: Column, include_raw: bool) -> DataFrame:
    """``id, value``: documents as JSON without null fields. Without the markup, it is not even read."""
    kept = docs.filter(condition)
    if not include_raw:
        kept = kept.drop("rawHTML")
    return kept.select("id", F.to_json(F.struct(*kept.columns)).alias("value"))


def title_content_export(docs: DataFrame, condition: Column, labels: tuple[str, ...] = ("title",)) -> DataFrame:
    """``id, value``: labels joined by ``/``, a space, and the content. A missing label is empty."""
    joined = F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("")) for c in labels))
    return docs.filter(condition).select(
        "id", F.concat(joined, F.lit(" "), F.coalesce("content", F.lit(""))).alias("value")
    )


def write_lines(export: DataFrame, path: str) -> None:
    export.select("value").write.text(path)
