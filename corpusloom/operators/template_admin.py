"""Checking, storing and choosing templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import selectors, values
from corpusloom.operators.documents import page_of
from corpusloom.schema import NOT_COMPARED, TEMPLATE_COLUMNS


def validate(templates: DataFrame) -> DataFrame:
    """Templates with ``violations``: the names of the rules they break."""
    bad_field = F.exists(
        "dynamicFields",
        lambda f: values.is_blank(f["name"]) | (values.is_blank(f["regex"]) & values.is_blank(f["xpath"])),
    )
    checks = {
        "no_start_url": F.coalesce(F.size("startURL"), F.lit(0)) <= 0,
        "blank_domain": values.is_blank(F.col("domain")),
        "slash_in_domain": F.col("domain").contains("/"),
        "no_thread": F.coalesce(F.col("thread"), F.lit(0)) <= 0,
        "blank_site_name": values.is_blank(F.col("siteName")),
        "short_timeout": F.coalesce(F.col("timeout"), F.lit(0)) <= 1000,
        "bad_dynamic_field": bad_field,
        "bad_regex": _has_bad_regex(templates),
        "bad_path_rule": _has_bad_path(templates),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())))
    return templates.withColumn("violations", found)


_REGEX_RULES = ("urlReg", "contentReg", "titleReg", "categoryReg", "publishTimeReg")
_PATH_RULES = ("contentXPath", "titleXPath", "categoryXPath", "publishTimeXPath")


def _rules_of(templates: DataFrame, columns: Sequence[str], field: str) -> Column:
    """The rules of one kind that a template has, blank ones left out."""
    own = F.array(*(F.col(c) for c in columns if c in templates.columns)).cast("array<string>")
    listed = F.concat(own, F.coalesce(F.transform("dynamicFields", lambda f: f[field]), F.array().cast("array<string>")))
    return F.filter(listed, lambda rule: ~values.is_blank(rule))


def _has_bad_regex(templates: DataFrame) -> Column:
    def compiled(rule: Column) -> Column:
        return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), rule)

    return F.exists(_rules_of(templates, _REGEX_RULES, "regex"), lambda rule: compiled(rule).isNull())


def _has_bad_path(templates: DataFrame) -> Column:
    """Templates without path rules cross to Python as nulls: one short call per batch of templates."""
    rules = _rules_of(templates, _PATH_RULES, "xpath")
    return F.size(selectors.unsupported_rules(F.when(F.size(rules) > 0, rules))) > 0


def unsupported_path_rules(templates: DataFrame) -> DataFrame:
    """Templates whose path rules lie outside the supported subset: ``id, messages``."""
    listed = F.concat(
        F.array("contentXPath", "titleXPath", "categoryXPath", "publishTimeXPath"),
        F.transform("dynamicFields", lambda f: f["xpath"]),
    )
    checked = templates.select("id", selectors.unsupported_rules(F.array_compact(listed)).alias("messages"))
    return checked.filter(F.size("messages") > 0)


def fingerprint() -> Column:
    """A digest of the columns that make templates different."""
    compared = [c for c in TEMPLATE_COLUMNS if c not in NOT_COMPARED]
    return F.sha2(F.to_json(F.struct(*compared), {"ignoreNullFields": "false"}), 256)


def known_ids(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming templates with the id of an equal stored template of the same domain, where there is one.

    Equal templates that arrive together share the lowest id among them.
    """
    by_content = Window.partitionBy("domain", "fingerprint").orderBy("id")
    existing = (
        stored.select("domain", fingerprint().alias("fingerprint"), F.col("id"))
        .groupBy("domain", "fingerprint")
        .agg(F.min("id").alias("_stored_id"))
    )
    marked = incoming.withColumn("fingerprint", fingerprint()).join(existing, ["domain", "fingerprint"], "left")
    return (
        marked.withColumn("_rank", F.row_number().over(by_content))
        .filter("_rank = 1")
        .withColumn("is_new", F.col("_stored_id").isNull())
        .withColumn("id", F.coalesce("_stored_id", "id"))
        .drop("_rank", "_stored_id", "fingerprint")
    )


def list_templates(templates: DataFrame, size: int, page: int) -> DataFrame:
    return page_of(templates, [F.col("id")], size, page)


def templates_of_domain(templates: DataFrame, domain: str, size: int, page: int) -> DataFrame:
    return page_of(templates.filter(F.col("domain") == domain), [F.col("id")], size, page)


def template_by_id(templates: DataFrame, template_id: str) -> DataFrame:
    found = templates.filter(F.col("id") == template_id)
    if found.isEmpty():
        raise LookupError(f"no template with id {template_id!r}")
    return found


def not_running(requested: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requested templates that no running task uses (``tasks`` has ``template_id, state``)."""
    running = tasks.filter(F.col("state") == "RUNNING").select(F.col("template_id").alias("id"))
    return requested.join(running, "id", "left_anti")


def start_batch(templates: DataFrame, ids: DataFrame | Sequence[str], tasks: DataFrame) -> DataFrame:
    """The templates of an id list that can start now; unknown, invalid and running ones are passed over."""
    wanted = (
        templates.join(ids.select("id").distinct(), "id", "left_semi")
        if isinstance(ids, DataFrame)
        else templates.filter(F.col("id").isin(*ids) if ids else F.lit(False))
    )
    valid = validate(wanted).filter(F.size("violations") == 0).drop("violations")
    return not_running(valid, tasks)
