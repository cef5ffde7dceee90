"""Raw pages and templates to documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import dates, markup, rules, selectors, urls, values
from corpusloom.schema import WEBPAGE
from corpusloom.session import is_small_and
from corpusloom.sources.templates import with_template_columns

_PATH_COLUMNS = ("contentXPath", "titleXPath", "categoryXPath", "publishTimeXPath")
_REGEX_COLUMNS = ("contentReg", "titleReg", "categoryReg", "publishTimeReg", "urlReg")


def prepare_templates(templates: DataFrame) -> DataFrame:
    """One row per template: ``(site, template_id, tpl)``.

    Everything that depends only on the template is worked out here, once per template: blank
    rules become null, regexes get their group, date formats become part regexes, and the path
    rules of the template are listed.
    """
    full = with_template_columns(templates)
    rule_names = _PATH_COLUMNS + _REGEX_COLUMNS + ("publishTimeFormat",)
    full = full.withColumns({name: values.blank_to_null(F.col(name)) for name in rule_names})
    whole = F.concat(F.lit("^(?:"), F.col("urlReg"), F.lit(")$"))
    full = full.withColumns(
        {"urlWhole": whole, **{name: rules.with_group(F.col(name)) for name in _REGEX_COLUMNS}}
    )
    fields = F.transform(
        "dynamicFields",
        lambda f: F.struct(
            f["name"].alias("name"),
            values.blank_to_null(f["xpath"]).alias("xpath"),
            rules.with_group(values.blank_to_null(f["regex"])).alias("regex"),
            F.coalesce(f["need"], F.lit(False)).alias("need"),
        ),
    )
    full = full.withColumn("dynamicFields", fields)
    path_rules = F.array_compact(
        F.concat(F.array(*_PATH_COLUMNS), F.transform("dynamicFields", lambda f: f["xpath"]))
    )
    full = dates.with_language_names(full).withColumns(
        {
            "pathRules": F.filter(F.array_distinct(path_rules), lambda r: ~selectors.is_flat(r)),
            "flatRules": F.transform(
                F.filter(F.array_distinct(path_rules), selectors.is_flat), selectors.flat_rule
            ),
            "datePieces": dates.format_pieces(F.col("publishTimeFormat"), F.col("months"), F.col("halves")),
            "linkReg": F.coalesce(F.col("urlReg"), urls.domain_link_regex(F.col("domain"))),
        }
    )
    date_rules = dates.format_rules("publishTimeFormat", "datePieces", "months", "pm")
    full = full.withColumn("dateRules", date_rules).drop("datePieces", "months", "halves", "pm")
    return full.select(F.col("domain").alias("site"), F.col("id").alias("template_id"), F.struct("*").alias("tpl"))


def match_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Give every page the template of its site.

    A page that names its template in ``template_id`` gets that one; otherwise the host decides.
    The template side is broadcast only after its size has been checked. Pages of a template that
    wants path rules beyond flat ones are parsed once here; if no template has any, no Python runs at all.
    """
    prepared = prepare_templates(templates)
    small, wants_paths = is_small_and(prepared, F.size("tpl.pathRules") > 0)
    side = F.broadcast(prepared) if small else prepared
    if "template_id" in pages.columns:
        matched = pages.join(side.drop("site"), "template_id")
    else:
        matched = pages.withColumn("site", urls.host_of(F.col("url"))).join(side, "site")
    flat = F.when(
        F.size("tpl.flatRules") > 0, selectors.flat_values(F.col("html"), F.col("tpl.flatRules"))
    )
    if wants_paths:
        none = F.create_map().cast("map<string,array<string>>")
        parsed = selectors.path_values(F.col("html"), F.col("tpl.pathRules"))
        flat = F.map_concat(F.coalesce(flat, none), F.coalesce(parsed, none))
    return matched.withColumn("paths", flat)


def _path_all(rule: Column) -> Column:
    return F.element_at(F.col("paths"), rule)


def _path_first(rule: Column) -> Column:
    return F.get(_path_all(rule), 0)


def _by_rule(path_rule: Column, regex: Column) -> Column:
    """Path rule if there is one, else regex; a rule that finds nothing gives null."""
    return F.when(path_rule.isNotNull(), _path_first(path_rule)).when(
        regex.isNotNull(), rules.first_match(F.col("html"), regex)
    )


def is_start_page() -> Column:
    return F.coalesce(F.array_contains("tpl.startURL", F.col("url")), F.lit(False))


def raw_body() -> Column:
    html, tpl = F.col("html"), F.col("tpl")
    return (
        F.when(tpl["contentXPath"].isNotNull(), F.array_join(_path_all(tpl["contentXPath"]), ""))
        .when(tpl["contentReg"].isNotNull(), F.array_join(rules.all_matches(html, tpl["contentReg"]), ""))
        .otherwise(markup.auto_body(html))
    )


def title() -> Column:
    html, tpl = F.col("html"), F.col("tpl")
    has_rule = tpl["titleXPath"].isNotNull() | tpl["titleReg"].isNotNull()
    return F.when(has_rule, _by_rule(tpl["titleXPath"], tpl["titleReg"])).otherwise(markup.page_title(html))


def category() -> Column:
    tpl = F.col("tpl")
    return F.coalesce(
        values.blank_to_null(_by_rule(tpl["categoryXPath"], tpl["categoryReg"])), tpl["defaultCategory"]
    )


def dynamic_values() -> Column:
    """``array<struct<name, need, value>>`` in template order; value is null where nothing matched."""
    return F.transform(
        "tpl.dynamicFields",
        lambda f: F.struct(
            f["name"].alias("name"), f["need"].alias("need"), _by_rule(f["xpath"], f["regex"]).alias("value")
        ),
    )


def publish_time(current_year: Column) -> Column:
    """By rule and format; by detection only where the template has no format and the rule found nothing."""
    html, tpl = F.col("html"), F.col("tpl")
    by_rule = _by_rule(tpl["publishTimeXPath"], tpl["publishTimeReg"])
    has_format = tpl["publishTimeFormat"].isNotNull()

    def moment(found: Column) -> Column:
        hit = F.when(tpl["autoDetectPublishDate"] & values.is_blank(found), dates.detect_date(html))
        return F.when(has_format, dates.parse_by_format(found, tpl["dateRules"], current_year)).otherwise(
            values.let(hit, lambda text: dates.parse_detected(text, current_year))
        )

    return values.let(by_rule, moment)


def _skip_reason() -> Column:
    tpl = F.col("tpl")
    return (
        F.when(tpl["needContent"] & values.is_blank(F.col("content")), "content")
        .when(tpl["needTitle"] & values.is_blank(F.col("title")), "title")
        .when(F.exists("dynamic", lambda d: d["need"] & values.is_blank(d["value"])), "dynamic_field")
        .when(tpl["needPublishTime"] & F.col("publishTime").isNull(), "publish_time")
    )


def extract_documents(
    pages: DataFrame, templates: DataFrame, run_id: str, gather_time: datetime
) -> DataFrame:
    """Documents with two verdict columns, ``is_start_page`` and ``skip_reason``.

    ``gather_time`` is a job parameter; its year completes dates that name none. A page column
    ``stored`` is passed through.
    """
    gathered = F.lit(gather_time).cast("timestamp")
    tpl = F.col("tpl")
    matched = match_templates(pages, templates)
    # One pass over the markup: nothing here leaves the row. Plain columns would be worked out again
    # by every filter on the verdict, which Spark moves below the select; a generator stays in place.
    read = F.struct(
        tpl["domain"].alias("domain"),
        markup.clean_body(raw_body()).alias("content"),
        title().alias("title"),
        category().alias("category"),
        dynamic_values().alias("dynamic"),
        publish_time(F.year(gathered)).alias("publishTime"),
        is_start_page().alias("is_start_page"),
    )
    carried = [c for c in ("stored",) if c in pages.columns]
    fields = matched.select("url", "html", "tpl", *carried, F.inline(F.array(read)))
    computed = {
        "id": F.md5("url"),
        "spiderUUID": F.lit(run_id),
        "spiderInfoId": tpl["id"],
        "rawHTML": F.when(tpl["saveCapture"], F.col("html")),
        "gatherTime": gathered,
        "dynamic_fields": F.map_from_entries(
            F.transform(values.last_by_name(F.col("dynamic")), lambda f: F.struct(f["name"], f["value"]))
        ),
        "staticFields": F.when(
            F.size(tpl["staticFields"]) > 0, F.map_from_entries(values.last_by_name(tpl["staticFields"]))
        ),
    }
    present = {"url", "domain", "title", "content", "category", "publishTime"}
    return fields.select(
        *(
            computed[f.name].alias(f.name)
            if f.name in computed
            else F.col(f.name)
            if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in WEBPAGE.fields
        ),
        "is_start_page",
        _skip_reason().alias("skip_reason"),
        *carried,
    )


def collected(extracted: DataFrame) -> DataFrame:
    """What a run stores: pages that pass their template and are not start pages."""
    return extracted.filter(~F.col("is_start_page") & F.col("skip_reason").isNull()).drop(
        "is_start_page", "skip_reason"
    )


def _known_template(templates: DataFrame, template_id: str) -> DataFrame:
    chosen = templates.filter(F.col("id") == template_id)
    if chosen.isEmpty():
        raise ValueError(f"template {template_id!r} is not in the template table")
    return chosen


def re_extract(
    store: DataFrame,
    old_template_id: str,
    templates: DataFrame,
    new_template_id: str,
    run_id: str,
    gather_time: datetime,
) -> DataFrame:
    """Updates for the stored documents of one template, read again with another template.

    Documents that the new template rejects, and those stored without markup, are left out and so
    stay as they are. Start pages are updated like any other.
    """
    chosen = _known_template(templates, new_template_id)
    pages = store.filter((F.col("spiderInfoId") == old_template_id) & F.col("rawHTML").isNotNull()).select(
        "url", F.col("rawHTML").alias("html"), F.lit(new_template_id).alias("template_id")
    )
    extracted = extract_documents(pages, chosen, run_id, gather_time)
    return extracted.filter(F.col("skip_reason").isNull()).drop("is_start_page", "skip_reason")


def re_extracted_store(
    store: DataFrame,
    old_template_id: str,
    templates: DataFrame,
    new_template_id: str,
    run_id: str,
    gather_time: datetime,
) -> DataFrame:
    """The store after ``re_extract`` and a partial update, without a join.

    The new fields come from the stored row itself, so the old row travels along and the two are
    merged in place: fields that the new template leaves null, and rejected rows, keep their values.
    """
    chosen = _known_template(templates, new_template_id)
    affected = F.coalesce((F.col("spiderInfoId") == old_template_id) & F.col("rawHTML").isNotNull(), F.lit(False))
    pages = store.filter(affected).select(
        "url",
        F.col("rawHTML").alias("html"),
        F.lit(new_template_id).alias("template_id"),
        F.struct(*store.columns).alias("stored"),
    )
    extracted = extract_documents(pages, chosen, run_id, gather_time)
    passed = F.col("skip_reason").isNull()
    merged = extracted.select(
        *(
            F.coalesce(F.when(passed, F.col(c)), F.col(f"stored.{c}")).alias(c)
            if c in WEBPAGE.names
            else F.col(f"stored.{c}").alias(c)
            for c in store.columns
        )
    )
    return store.filter(~affected).unionByName(merged)


def preview(
    pages: DataFrame, templates: DataFrame, gather_time: datetime, sample_pages: int | None = None
) -> DataFrame:
    """Try templates on the given pages, or on a few of them; nothing is stored."""
    sample = pages if sample_pages is None else pages.limit(sample_pages)
    return extract_documents(sample, templates, "preview", gather_time)
