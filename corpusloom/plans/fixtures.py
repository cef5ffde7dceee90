"""Frames that the registered queries derive from the given tables.

Each comes twice: as a Spark frame and as SQL text for the check. Both grow with the tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.session import dealt, spread

RUN = "run-1"
GATHERED = datetime(2024, 3, 5, 8, 0, 0)
HEX_DIGITS = "0123456789abcdef"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the column names of the store."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("domain"),
        F.col("lang").alias("category"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 30).cast("int"))).alias(
            "gatherTime"
        ),
        F.concat(F.lit("run-"), (F.col("doc_id") % 7).cast("string")).alias("spiderUUID"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and content only, for work on every word."""
    return spread(documents(spark, sf_dir).select("id", "content"))


DOCUMENTS_SQL = """docs AS (
  SELECT doc_id AS id, text AS content, source AS domain, lang AS category,
         TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INTEGER) AS "gatherTime",
         'run-' || (doc_id % 7) AS "spiderUUID"
  FROM documents)"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("host"), "url")
    return (
        found.groupBy("host")
        .agg(F.min("url").alias("first_url"), F.max("url").alias("last_url"), F.count("*").alias("n_pages"))
        .withColumn("h", F.instr(F.lit(HEX_DIGITS), F.substring(F.md5("host"), 1, 1)) - 1)
    )


HOSTS_SQL = r"""hosts AS (
  SELECT host, min(url) AS first_url, max(url) AS last_url, count(*) AS n_pages,
         instr('0123456789abcdef', substr(md5(host), 1, 1)) - 1 AS h
  FROM (SELECT regexp_extract(url, '^\w+://([^/:?#]+)', 1) AS host, url FROM pages)
  GROUP BY host)"""

TITLE_RULE = "<h1>(.*?)</h1>"
BODY_RULE = "(?s)<article>(.*?)</article>"
LANGUAGE_RULE = r'<html lang="(\w+)">'
LINK_RULE = r"https?://[^/]+/(?:en|fr|de|es|deep|frame)/\d+"
OWNER_RULE = r"&copy; ([^ ]+) "
PAGE_RULE = r'track\(\d+\);'


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per host. By the first digit of the host's hash: regex rules or none, and the switches."""
    h = F.col("h")

    def rule(condition: Column, text: str) -> Column:
        return F.when(condition, F.lit(text))

    def field(name: str, regex: str, need: Column) -> Column:
        return F.struct(
            F.lit(regex).alias("regex"), F.lit("").alias("xpath"), F.lit(name).alias("name"), need.alias("need")
        )

    return hosts(spark, sf_dir).select(
        F.concat(F.lit("tpl-"), F.md5("host")).alias("id"),
        F.when(h == 13, F.lit(" ")).otherwise(F.col("host")).alias("siteName"),
        F.col("host").alias("domain"),
        F.array("first_url").alias("startURL"),
        rule(h % 4 == 0, LINK_RULE).alias("urlReg"),
        rule(h % 2 == 0, TITLE_RULE).alias("titleReg"),
        rule(h % 2 == 0, BODY_RULE).alias("contentReg"),
        rule(h % 4 == 0, LANGUAGE_RULE).alias("categoryReg"),
        F.lit("uncategorised").alias("defaultCategory"),
        F.array(
            field("owner", OWNER_RULE, F.lit(False)),
            field("number", PAGE_RULE, F.lit(True)),
            field("day", r"\d{2}-\d{2}", h == 6),
        ).alias("dynamicFields"),
        F.array(
            F.struct(F.lit("site").alias("name"), F.lit("old").alias("value")),
            F.struct(F.lit("site").alias("name"), F.col("host").alias("value")),
        ).alias("staticFields"),
        (h % 8 == 3).alias("gatherFirstPage"),
        F.lit(True).alias("needContent"),
        F.lit(True).alias("needTitle"),
        (h == 9).alias("needPublishTime"),
        (h % 2 == 1).alias("autoDetectPublishDate"),
        (h % 3 != 0).alias("saveCapture"),
        (h % 5).cast("int").alias("maxPageGather"),
        F.when(h == 11, 500).otherwise(5000).alias("timeout"),
        F.when(h == 7, 0).otherwise(1).alias("thread"),
    )


# The same templates as far as the checks need them.
TEMPLATES_SQL = rf"""tpl AS (
  SELECT host AS domain, 'tpl-' || md5(host) AS id, first_url, h,
         h % 2 = 0 AS has_rules, h % 4 = 0 AS has_link_rule, h % 8 = 3 AS first_page_only,
         h % 2 = 1 AS detects, h = 9 AS need_time, h = 6 AS need_day, h % 3 <> 0 AS saves,
         h % 5 AS max_pages
  FROM hosts)"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with links of every kind appended to the markup."""
    number = F.col("page_id").cast("string")
    host = urls.host_of(F.col("url"))
    extra = F.concat(
        F.lit('<a href="https://'), host, F.lit("/deep/"), number, F.lit('">deep</a>'),
        F.lit("<a class='x' href='/file/"), number, F.lit(".PDF'>file</a>"),
        F.lit('<a href="https://'), host, F.lit('/lib/nodejs">lib</a>'),
        F.lit('<a href="https://mirror.'), host, F.lit("/en/"), number, F.lit('">mirror</a>'),
        F.lit('<a href="/frag/'), number, F.lit('#part">part</a>'),
        F.lit('<iframe src="https://'), host, F.lit("/frame/"), number, F.lit('"></iframe>'),
        F.lit('<iframe src="https://frames.example.org/f"></iframe>'),
    )
    return pages(spark, sf_dir).withColumn("html", F.concat("html", extra))


PAGE_LINKS_SQL = r"""page_links AS (
  SELECT page_id, url, host, html
    || '<a href="https://' || host || '/deep/' || page_id || '">deep</a>'
    || '<a class=''x'' href=''/file/' || page_id || '.PDF''>file</a>'
    || '<a href="https://' || host || '/lib/nodejs">lib</a>'
    || '<a href="https://mirror.' || host || '/en/' || page_id || '">mirror</a>'
    || '<a href="/frag/' || page_id || '#part">part</a>'
    || '<iframe src="https://' || host || '/frame/' || page_id || '"></iframe>'
    || '<iframe src="https://frames.example.org/f"></iframe>' AS html
  FROM (SELECT *, regexp_extract(url, '^\w+://([^/:?#]+)', 1) AS host FROM pages))"""

# Date forms by number, as Spark patterns and as strftime patterns.
_FORM_PATTERNS = (
    ("yyyy年MM月dd日 HH:mm:ss", "%Y年%m月%d日 %H:%M:%S"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy年MM月dd日HH:mm:ss", "%Y年%m月%d日%H:%M:%S"),
    ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"),
    ("yyyy-MM-ddHH:mm:ss", "%Y-%m-%d%H:%M:%S"),
    ("yyyy/MM/ddHH:mm:ss", "%Y/%m/%d%H:%M:%S"),
    ("yyyy年MM月dd日 HH:mm", "%Y年%m月%d日 %H:%M"),
    ("MM月dd日 HH:mm:ss", "%m月%d日 %H:%M:%S"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    ("yyyy年MM月dd日HH:mm", "%Y年%m月%d日%H:%M"),
    ("yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M"),
    ("MM月dd日HH:mm:ss", "%m月%d日%H:%M:%S"),
    ("MM-dd HH:mm:ss", "%m-%d %H:%M:%S"),
    ("yyyy-MM-ddHH:mm", "%Y-%m-%d%H:%M"),
    ("yyyy/MM/ddHH:mm", "%Y/%m/%d%H:%M"),
    ("MM-ddHH:mm:ss", "%m-%d%H:%M:%S"),
    ("MM月dd日 HH:mm", "%m月%d日 %H:%M"),
    ("MM月dd日HH:mm", "%m月%d日%H:%M"),
    ("MM-dd HH:mm", "%m-%d %H:%M"),
    ("MM-ddHH:mm", "%m-%d%H:%M"),
    ("yyyy年MM月dd日", "%Y年%m月%d日"),
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM月dd日", "%m月%d日"),
    ("MM-dd", "%m-%d"),
)
N_FORMS = len(_FORM_PATTERNS)


def dated_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.ts`` written in one of the date forms. Every 7th row has no date, every 11th month 13."""
    number = (F.col("event_id") % N_FORMS).cast("int")
    text = F.lit(None).cast("string")
    for i, (pattern, _) in enumerate(_FORM_PATTERNS):
        text = F.when(number == i, F.date_format("ts", pattern)).otherwise(text)
    # January becomes month 13: the first "01" followed by a month separator.
    text = F.when(F.col("event_id") % 11 == 0, F.regexp_replace(text, r"(^|[-/年])01([-/月])", "$113$2")).otherwise(text)
    body = F.when(F.col("event_id") % 7 == 0, F.lit("none")).otherwise(text)
    return dealt(table(spark, sf_dir, "events").select("event_id", "ts")).select(
        "event_id",
        "ts",
        number.alias("fmt_no"),
        F.concat(F.lit('<p id="x">a</p><span class="t">'), body, F.lit("</span>")).alias("html"),
    )


DATED_HTML_SQL = (
    "dated_html AS (SELECT event_id, ts, fmt_no, '<p id=\"x\">a</p><span class=\"t\">' || "
    "CASE WHEN event_id % 7 = 0 THEN 'none' WHEN event_id % 11 = 0 THEN "
    r"regexp_replace(written, '(^|[-/年])01([-/月])', '\113\2') ELSE written END || '</span>' AS html "
    "FROM (SELECT event_id, ts, (event_id % "
    + str(N_FORMS)
    + ")::INTEGER AS fmt_no, CASE event_id % "
    + str(N_FORMS)
    + "".join(f" WHEN {i} THEN strftime(ts, '{f}')" for i, (_, f) in enumerate(_FORM_PATTERNS))
    + " END AS written FROM events))"
)


def price_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price tables, one single-quoted JSON text per part."""
    unit = F.concat(
        F.lit("'"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
        F.lit("':{'qty':"), F.when(F.col("l_discount") == 0, F.lit("0")).otherwise(F.lit("2")),
        F.lit(",'price':'<span class=\\'price\\'>"),
        F.when(F.col("l_linenumber") == 7, F.lit("sold")).otherwise(
            F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"))),
        F.lit("</span>','sku':'s"), F.col("l_suppkey").cast("string"), F.lit("-"),
        F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
        F.lit("','size':'"), F.col("l_linenumber").cast("string"), F.lit("y'}"),
    )
    outer = F.when(F.col("l_returnflag") == "R", F.lit("-1")).otherwise(F.col("l_linestatus"))
    groups = (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", outer.alias("outer_key"), unit.alias("unit"))
        .groupBy("l_partkey", "outer_key")
        .agg(F.array_join(F.sort_array(F.collect_list("unit")), ",").alias("units"))
    )
    inner = F.concat(F.lit("'"), F.col("outer_key"), F.lit("':{"), F.col("units"), F.lit("}"))
    return groups.groupBy("l_partkey").agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(inner)), ","), F.lit("}")).alias("price_json")
    ).select(F.col("l_partkey").alias("id"), "price_json")


def attr_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = F.col("p_partkey") % 5 == 0
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(
            F.array(
                F.concat(F.lit("brand:"), "p_brand"),
                F.concat(F.lit("type："), "p_type"),
                F.lit("a:b:c"),
                F.lit("empty:"),
            ),
            F.when(five, F.array(F.concat(F.lit("brand:"), "p_name"))).otherwise(
                F.expr("cast(array() as array<string>)")
            ),
        ).alias("attrs"),
        "p_name",
        "p_retailprice",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = key.cast("string")
    third = F.col("p_size") % 3
    flag = F.when(third == 0, True).when(third == 1, False)
    links = F.array(
        F.concat(F.lit("https://shop.example.com/item/"), text),
        F.when(key % 13 == 0, F.lit("no link")).otherwise(F.concat(F.lit("http://shop.example.net/i?id="), text)),
    )
    none = F.expr("cast(array() as array<string>)")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("modelNo"),
        F.when(key % 10 == 0, none).otherwise(links).alias("productUrls"),
        (key % 4 != 0).alias("fetchKeywords"),
        flag.alias("fetchAttrs"),
        F.when(key % 2 == 0, F.array(F.create_map(F.lit("brand"), F.col("p_brand")))).alias("attrs"),
    )


CATALOGUE_SQL = """catalogue AS (
  SELECT p_partkey AS id, p_name AS "modelNo", p_brand, p_partkey % 4 <> 0 AS keywords_wanted,
         CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS attrs_done,
         CASE WHEN p_partkey % 10 = 0 THEN []::VARCHAR[] ELSE
           ['https://shop.example.com/item/' || p_partkey,
            CASE WHEN p_partkey % 13 = 0 THEN 'no link' ELSE 'http://shop.example.net/i?id=' || p_partkey END]
         END AS links
  FROM part)"""


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    kind = (
        F.when(n % 7 == 0, F.lit("application/pdf")).when(n % 7 == 1, F.lit(None).cast("string"))
        .otherwise(F.lit("Text/HTML; charset=utf-8"))
    )
    return pages(spark, sf_dir).select(
        "page_id",
        "url",
        "html",
        F.when(n % 11 == 0, 404).otherwise(200).alias("status"),
        kind.alias("content_type"),
        (F.length("html").cast("long") * F.when(n % 5 == 0, 400).otherwise(1)).alias("content_length"),
        F.when(n % 3 == 0, F.lit("utf-8")).otherwise(F.lit("")).alias("charset"),
    )


FETCH_LOG_SQL = """fetch_log AS (
  SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status,
         CASE WHEN page_id % 7 = 0 THEN 'application/pdf' WHEN page_id % 7 = 1 THEN NULL
              ELSE 'Text/HTML; charset=utf-8' END AS content_type,
         length(html) * CASE WHEN page_id % 5 = 0 THEN 400 ELSE 1 END AS content_length,
         CASE WHEN page_id % 3 = 0 THEN 'utf-8' ELSE '' END AS charset
  FROM pages)"""


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the event log of runs."""
    kind = F.col("event_type")
    state = F.when(kind == "signup", "INIT").when(kind.isin("view", "click"), "RUNNING").when(
        kind == "purchase", "STOP"
    ).otherwise("FAIL")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"),
        "ts",
        state.alias("state"),
        "value",
        F.col("props").alias("extra"),
    )


TASK_EVENTS_SQL = """task_events AS (
  SELECT event_id, 'task-' || user_id AS task_id, ts, value, props AS extra,
         CASE WHEN event_type = 'signup' THEN 'INIT' WHEN event_type IN ('view', 'click') THEN 'RUNNING'
              WHEN event_type = 'purchase' THEN 'STOP' ELSE 'FAIL' END AS state
  FROM events)"""

TOKENS_SQL = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"


def with_sql(*parts: str) -> str:
    """A WITH clause of derived frames."""
    return "WITH " + ",\n".join(parts) + "\n"
