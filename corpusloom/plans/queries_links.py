"""Registered queries: what to fetch next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import extraction, frontier
from corpusloom.plans import fixtures as fx


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.seeds(fx.templates(spark, sf_dir), fx.RUN).select("run_id", "url")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.page_links(spark, sf_dir).select("page_id", "url", "html")
    return extraction.match_templates(pages, fx.templates(spark, sf_dir))


def links_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matched(spark, sf_dir).filter(F.col("tpl.urlReg").isNotNull())
    return found.select(F.col("url").alias("source_url"), F.explode(frontier.followed_links()).alias("url"))


def links_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matched(spark, sf_dir).filter(F.col("tpl.urlReg").isNull())
    return found.select(F.col("url").alias("source_url"), F.explode(frontier.followed_links()).alias("url"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matched(spark, sf_dir)
    return found.select(F.col("url").alias("source_url"), F.explode(frontier.followed_frames()).alias("url"))


def first_page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).filter(frontier.may_follow()).select("url")


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.discover_links(_matched(spark, sf_dir), fx.RUN)


def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page against a store of the pages and the linked folder of the first site."""
    links = _frontier(spark, sf_dir)
    stored = fx.pages(spark, sf_dir).select(F.md5("url").alias("id"))
    deep = links.filter(F.col("url").contains("/deep/")).select(F.md5("url").alias("id"))
    return frontier.new_links(links, stored.unionByName(deep).distinct()).select("run_id", "url", "source_url")


def capped_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as links of one run per host, in page order."""
    pages = fx.table(spark, sf_dir, "pages").select("page_id", "url")
    links = pages.withColumn("run_id", F.regexp_extract("url", r"^\w+://([^/:?#]+)", 1))
    kept = frontier.cap_queue(links, [F.col("page_id"), F.col("url")], cap=3)
    return kept.select("run_id", "url", F.col("position").cast("long").alias("position"))


def crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as handled pages: runs by user, effective by value, maximum by user."""
    events = fx.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").cast("string").alias("url"),
        "event_id",
        (F.col("value") > 8).alias("effective"),
        (F.col("user_id") % 4 * 5).cast("int").alias("maxPageGather"),
    )
    return frontier.within_budget(events, [F.col("event_id")]).select("run_id", "event_id", "effective")


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = frontier.judge_fetches(fx.fetch_log(spark, sf_dir))
    return frontier.accepted_fetches(judged).select("page_id", "url")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.failed_fetches(frontier.judge_fetches(fx.fetch_log(spark, sf_dir)))


def refetch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages themselves as refetch table; stored are the linked folders."""
    links = _frontier(spark, sf_dir)
    deep = links.filter(F.col("url").contains("/deep/")).select(F.md5("url").alias("id"))
    wider = frontier.with_refetch_list(links, fx.pages(spark, sf_dir).select("url"), fx.RUN)
    return frontier.new_links(wider, deep.distinct()).select("run_id", "url")


def link_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.link_log(_frontier(spark, sf_dir))


QUERIES = {
    "d1_seeds": seeds,
    "d2_links_by_rule": links_by_rule,
    "d3_links_by_site": links_by_site,
    "d4_frames": frames,
    "d5_first_page_gate": first_page_gate,
    "d6_new_links": new_links,
    "d7_capped_queue": capped_queue,
    "d8_crawl_budget": crawl_budget,
    "d9_accepted_fetches": accepted,
    "d10_failed_fetches": failures,
    "d11_refetch_list": refetch_list,
    "d13_link_log": link_log,
}

# Links of a page in the check: anchors by regex, made absolute (the markup has absolute links and
# links from the root only), then the template's condition.
_SUFFIXES = "zip|exe|doc|docx|jpg|png|jpeg|mp3|mp4|mkv|rmvb|ppt|pptx|iso|dmg|apk|jar|pdf|xls|xlsx|js|cpp|gif|rar|xml"
_LINKS = rf"""anchors AS (
  SELECT l.url AS source_url, tpl.*,
    unnest(regexp_extract_all(l.html, '<a [^>]*?href=["'']([^"'']*)["'']', 1)) AS href
  FROM page_links l JOIN tpl ON tpl.domain = l.host),
absolute AS (
  SELECT *, CASE WHEN href LIKE '/%' THEN regexp_extract(source_url, '^(\w+://[^/?#]*)', 1) || href ELSE href END AS link
  FROM anchors),
by_rule AS (
  SELECT source_url, first_url, first_page_only, regexp_extract(regexp_extract(link, '({fx.LINK_RULE})', 1), '^[^#]*') AS url
  FROM absolute WHERE has_link_rule AND regexp_matches(link, '{fx.LINK_RULE}')),
by_site AS (
  SELECT source_url, first_url, first_page_only, regexp_extract(link, '^[^#]*') AS url FROM absolute
  WHERE NOT has_link_rule AND regexp_extract(link, '^https?://([^/]+)/', 1) = domain
    AND NOT regexp_matches(lower(regexp_extract(link, '^[^#]*')), '(?:{_SUFFIXES})$')),
frames AS (
  SELECT source_url, first_url, first_page_only, src AS url FROM (
    SELECT l.url AS source_url, tpl.*, unnest(regexp_extract_all(l.html, '<iframe src="([^"]*)"', 1)) AS src
    FROM page_links l JOIN tpl ON tpl.domain = l.host)
  WHERE CASE WHEN has_link_rule THEN regexp_full_match(src, '{fx.LINK_RULE}')
             ELSE regexp_extract(src, '^\w+://([^/]*)', 1) = domain END),
frontier AS (
  SELECT * FROM (SELECT * FROM by_rule UNION ALL SELECT * FROM by_site UNION ALL SELECT * FROM frames)
  WHERE NOT first_page_only OR source_url = first_url)"""
_W = fx.with_sql(fx.HOSTS_SQL, fx.TEMPLATES_SQL, fx.PAGE_LINKS_SQL, _LINKS)
_FETCHES = fx.with_sql(
    fx.FETCH_LOG_SQL,
    """judged AS (SELECT *, CASE WHEN status <> 200 THEN 'status ' || status WHEN charset <> '' THEN NULL
      WHEN lower(content_type) NOT LIKE '%text/html%' THEN 'content type ' || content_type
      WHEN content_length > 1048576 THEN 'length ' || content_length END AS reason FROM fetch_log)""",
)

CHECKS = {
    "d1_seeds": fx.with_sql(fx.HOSTS_SQL) + "SELECT 'run-1' AS run_id, first_url AS url FROM hosts",
    "d2_links_by_rule": _W + "SELECT source_url, url FROM by_rule",
    "d3_links_by_site": _W + "SELECT source_url, url FROM by_site",
    "d4_frames": _W + "SELECT source_url, url FROM frames",
    "d5_first_page_gate": fx.with_sql(fx.HOSTS_SQL)
    + r"""SELECT url FROM pages JOIN hosts ON host = regexp_extract(url, '^\w+://([^/:?#]+)', 1)
        WHERE h % 8 <> 3 OR url = first_url""",
    "d6_new_links": _W
    + """SELECT 'run-1' AS run_id, url, min(source_url) AS source_url FROM frontier
        WHERE url NOT LIKE '%/deep/%' AND url NOT IN (SELECT url FROM pages) GROUP BY url""",
    "d7_capped_queue": r"""SELECT run_id, url, position FROM (SELECT run_id, url, row_number() OVER (
        PARTITION BY run_id ORDER BY page_id, url) AS position
        FROM (SELECT regexp_extract(url, '^\w+://([^/:?#]+)', 1) AS run_id, url, page_id FROM pages)) WHERE position <= 4""",
    "d8_crawl_budget": """SELECT run_id, event_id, effective FROM (
        SELECT *, row_number() OVER w AS n, coalesce(sum(effective::INTEGER) OVER (
          w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
        FROM (SELECT 'run-' || user_id AS run_id, event_id, value > 8 AS effective, user_id % 4 * 5 AS most FROM events)
        WINDOW w AS (PARTITION BY run_id ORDER BY event_id))
        WHERE most = 0 OR (done < most AND n <= most * 2 + 1)""",
    "d9_accepted_fetches": _FETCHES + "SELECT page_id, url FROM judged WHERE reason IS NULL",
    "d10_failed_fetches": _FETCHES + "SELECT url, reason FROM judged WHERE reason IS NOT NULL",
    "d11_refetch_list": _W
    + """SELECT DISTINCT 'run-1' AS run_id, url FROM (SELECT url FROM frontier UNION ALL SELECT url FROM pages)
        WHERE url NOT LIKE '%/deep/%'""",
    "d13_link_log": _W
    + "SELECT 'run-1' AS run_id, count(*) AS n_links, count(DISTINCT url) AS n_distinct FROM frontier",
}
