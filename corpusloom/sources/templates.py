"""Extraction templates from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import values
from corpusloom.schema import TEMPLATE_COLUMNS


def _as_text(spark_type: str) -> str:
    """The same shape with every leaf a string, since the files hold numbers as text."""
    for leaf in ("boolean", "int"):
        spark_type = spark_type.replace(leaf, "string")
    return spark_type


_TEXT_SCHEMA = ", ".join(f"`{name}` {_as_text(kind)}" for name, (kind, _) in TEMPLATE_COLUMNS.items())


def _typed(name: str, kind: str, default: object) -> Column:
    raw = F.col(f"raw.{name}")
    if kind in ("int", "boolean"):
        value = F.trim(raw).try_cast(kind)
    elif kind == "string":
        value = values.blank_to_null(raw)
    elif name == "dynamicFields":
        value = F.transform(
            raw,
            lambda f: F.struct(
                values.blank_to_null(f["regex"]).alias("regex"),
                values.blank_to_null(f["xpath"]).alias("xpath"),
                values.blank_to_null(f["name"]).alias("name"),
                F.coalesce(F.trim(f["need"]).try_cast("boolean"), F.lit(False)).alias("need"),
            ),
        )
    else:
        value = raw
    if default is None:
        return value.cast(kind).alias(name)
    fallback = F.expr(f"cast(array() as {kind})") if default == [] else F.lit(default)
    return F.coalesce(value.cast(kind), fallback).alias(name)


def parse_templates(df: DataFrame, json_column: str) -> DataFrame:
    """One template per row of JSON text. Unknown keys are ignored, missing ones get defaults."""
    return df.select(F.from_json(json_column, _TEXT_SCHEMA).alias("raw")).select(
        *(_typed(name, kind, default) for name, (kind, default) in TEMPLATE_COLUMNS.items())
    )


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file."""
    return parse_templates(spark.read.text(path, wholetext=True), "value")


def with_template_columns(df: DataFrame) -> DataFrame:
    """Complete a frame that has only some template columns with the defaults."""
    return df.select(
        *(
            (
                F.col(name).cast(kind)
                if name in df.columns
                else F.expr(f"cast(array() as {kind})")
                if default == []
                else F.lit(default).cast(kind)
            ).alias(name)
            for name, (kind, default) in TEMPLATE_COLUMNS.items()
        )
    )
