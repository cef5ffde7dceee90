"""Links to fetch next: discovery, guards, de-duplication and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import markup, rules, urls, values
from corpusloom.operators.extraction import is_start_page

MAX_PAGE_BYTES = 1_048_576
QUEUE_CAP = 100_000
CRAWL_RATIO = 2

_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_IFRAME = r"""(?is)<iframe\s(?:[^>]*?\s)?src\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def seeds(templates: DataFrame, run_id: str) -> DataFrame:
    """Start URLs of the templates. They are fetched on every run, so they skip ``new_links``."""
    return templates.select(
        F.lit(run_id).alias("run_id"),
        F.explode("startURL").alias("url"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(False).alias("detail"),
    )


def _attribute_values(html: Column, pattern: str) -> Column:
    visible = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    quoted = F.regexp_extract_all(visible, F.lit(pattern), F.lit(1))
    return F.transform(quoted, lambda v: markup.unescape(F.regexp_replace(v, r"""^["']|["']$""", "")))


def anchor_links(html: Column, page_url: Column) -> Column:
    """All ``<a href>`` targets of a page as absolute URLs."""
    return F.transform(_attribute_values(html, _ANCHOR), lambda href: urls.resolve_url(page_url, href))


def frame_links(html: Column) -> Column:
    """All ``<iframe src>`` values as they are written."""
    return _attribute_values(html, _IFRAME)


def followed_links(suffixes: Sequence[str] = urls.IGNORED_SUFFIXES) -> Column:
    """Links of a page that its template follows, fragments removed.

    With a URL rule that is every match of the rule. Without one it is every link of the site
    except those with an ignored suffix.
    """
    tpl = F.col("tpl")
    found = F.flatten(
        F.transform(
            anchor_links(F.col("html"), F.col("url")), lambda link: rules.all_matches(link, tpl["linkReg"])
        )
    )
    bare = F.transform(found, urls.strip_fragment)
    allowed = F.filter(bare, lambda link: ~urls.has_ignored_suffix(link, suffixes))
    return F.when(tpl["urlReg"].isNotNull(), bare).otherwise(allowed)


def followed_frames() -> Column:
    """Frame sources that match the whole URL rule, or lie on the site if there is no rule, as absolute URLs."""
    tpl = F.col("tpl")
    accepted = F.filter(
        frame_links(F.col("html")),
        lambda src: F.when(
            tpl["urlReg"].isNotNull(), F.call_function("rlike", src, tpl["urlWhole"])
        ).otherwise(urls.link_domain(src) == tpl["domain"]),
    )
    named = F.filter(accepted, lambda src: ~src.rlike(r"(?i)^\s*(?:$|#|javascript:)"))
    return F.transform(named, lambda src: urls.resolve_url(F.col("url"), src))


def may_follow() -> Column:
    """Templates may restrict link discovery to their start pages."""
    return ~F.col("tpl.gatherFirstPage") | is_start_page()


def discover_links(
    matched: DataFrame, run_id: str, suffixes: Sequence[str] = urls.IGNORED_SUFFIXES
) -> DataFrame:
    """Frontier rows of pages that ``match_templates`` has joined; one row per link occurrence."""
    links = F.concat(followed_links(suffixes), followed_frames())
    return matched.filter(may_follow()).select(
        F.lit(run_id).alias("run_id"),
        F.explode(links).alias("url"),
        F.col("url").alias("source_url"),
        F.lit(False).alias("detail"),
    )


def new_links(frontier: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Links seen for the first time in their run whose document is not stored yet.

    The de-duplication is a partial aggregate, so a link that every page of a site carries is
    reduced before the shuffle. Stored ids are unique, which leaves no hot key for the anti join.
    """
    first_seen = frontier.filter(F.col("url") != "").groupBy("run_id", "url").agg(
        F.min("source_url").alias("source_url"), F.max("detail").alias("detail")
    )
    return (
        first_seen.withColumn("id", F.md5("url"))
        .join(stored_ids.select("id"), "id", "left_anti")
        .select("run_id", "url", "source_url", "detail")
    )


def first_per_group(
    df: DataFrame, group: str, order: Sequence[Column], limit: Column, most: int, spread: Column, salts: int = 64
) -> DataFrame:
    """The first ``limit`` rows of every group, numbered from 1 in ``position``; ``most`` is the largest limit.

    ``most`` is a literal, so Spark limits the groups before it shuffles them.

    A row among the first n of its group is also among the first n of any part of it. So each
    group is cut into ``salts`` parts that are ranked apart, and only the survivors are ranked
    together: the last task of a group sees at most ``salts * limit`` rows, however hot the group.
    """
    salted = df.withColumn("_part", values.salt_of(spread, salts))
    part = Window.partitionBy(group, "_part").orderBy(*order)
    survivors = salted.withColumn("position", F.row_number().over(part)).filter(F.col("position") <= most)
    survivors = survivors.filter(F.col("position") <= limit)
    whole = Window.partitionBy(group).orderBy(*order)
    return (
        survivors.drop("_part")
        .withColumn("position", F.row_number().over(whole))
        .filter(F.col("position") <= most)
        .filter(F.col("position") <= limit)
    )


def cap_queue(frontier: DataFrame, order: Sequence[Column], cap: int = QUEUE_CAP) -> DataFrame:
    """At most ``cap + 1`` links per run, in discovery order: a link enters while no more than ``cap`` wait."""
    return first_per_group(frontier, "run_id", order, F.lit(cap + 1), cap + 1, F.col("url"))


def within_budget(processed: DataFrame, order: Sequence[Column], ratio: int = CRAWL_RATIO) -> DataFrame:
    """Pages a run handles before it stops.

    ``processed`` has ``run_id, url, effective, maxPageGather``. A run stops once its effective
    pages reach the maximum, or once it has handled more than ``ratio`` times the maximum; the
    page that crosses a limit has been handled. A maximum of zero means no limit.
    """
    unlimited = processed.filter(F.col("maxPageGather") <= 0)
    most = F.col("maxPageGather") * ratio + 1
    bounded = processed.filter(F.col("maxPageGather") > 0)
    largest = (bounded.agg(F.max("maxPageGather")).first()[0] or 0) * ratio + 1
    limited = first_per_group(bounded, "run_id", order, most, largest, F.col("url"))
    before = Window.partitionBy("run_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(F.col("effective").cast("int")).over(before), F.lit(0))
    kept = limited.withColumn("_done", done).filter(F.col("_done") < F.col("maxPageGather"))
    return kept.drop("_done", "position").unionByName(unlimited)


def judge_fetches(
    fetches: DataFrame, max_bytes: int = MAX_PAGE_BYTES, accepted_status: Sequence[int] = (200,)
) -> DataFrame:
    """Fetch log with a ``reason`` column: null for accepted pages.

    Type and length are looked at only where the template sets no charset, and a missing content
    type is no fault.
    """
    unguarded = ~values.is_blank(F.col("charset"))
    kind, length = F.col("content_type"), F.col("content_length")
    reason = (
        F.when(
            F.col("status").isNull() | ~F.col("status").isin(*accepted_status),
            F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown"))),
        )
        .when(unguarded, F.lit(None).cast("string"))
        .when(
            kind.isNotNull() & ~F.lower(kind).contains("text/html"), F.concat(F.lit("content type "), kind)
        )
        .when(length > max_bytes, F.concat(F.lit("length "), length.cast("string")))
    )
    return fetches.withColumn("reason", reason)


def accepted_fetches(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNull()).drop("reason")


def failed_fetches(judged: DataFrame) -> DataFrame:
    """The failure log: URL and reason."""
    return judged.filter(F.col("reason").isNotNull()).select("url", "reason")


def with_refetch_list(frontier: DataFrame, refetch: DataFrame, run_id: str) -> DataFrame:
    """Add a table of URLs to fetch again; ``new_links`` then treats them like any other link."""
    extra = refetch.select(
        F.lit(run_id).alias("run_id"),
        "url",
        F.lit(None).cast("string").alias("source_url"),
        F.lit(False).alias("detail"),
    )
    return frontier.unionByName(extra)


def write_links(frontier: DataFrame, path: str) -> None:
    """Append the links of a run, every occurrence, to a table with a folder per run."""
    frontier.write.partitionBy("run_id").mode("append").parquet(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, source_url string, detail boolean, run_id string").parquet(path)


def link_log(frontier: DataFrame) -> DataFrame:
    """Links and distinct links per run."""
    per_link = frontier.groupBy("run_id", "url").agg(F.count("*").alias("n"))
    return per_link.groupBy("run_id").agg(
        F.sum("n").alias("n_links"), F.count("*").alias("n_distinct")
    )
