"""Registered queries: sources, sinks and exports. They write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import mutations
from corpusloom.plans import fixtures as fx
from corpusloom.session import new_path
from corpusloom.sources import exports, sinks, snapshots
from corpusloom.sources.raw_pages import read_raw_pages


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_raw_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select("url", F.md5("html").alias("html_md5"), "status", "content_type")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.documents(spark, sf_dir).withColumns(
        {
            "id": F.col("id").cast("string"),
            "title": F.when(F.col("id") % 5 != 0, F.substring("content", 1, 20)),
            "rawHTML": F.concat(F.lit("<p>"), "content"),
        }
    )


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    sinks.json_sink(path)(_docs(spark, sf_dir))
    stored = spark.read.schema("id string, domain string, content string, spiderUUID string").json(path)
    return stored.select("id", "domain", "spiderUUID", F.md5("content").alias("content_md5"))


def document_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first batch of all documents, then a second: some again and later, some new, one id many times."""
    root = new_path(spark, "documents")
    docs = _docs(spark, sf_dir).select("id", "domain", "category", "gatherTime")
    sink = sinks.document_sink(root)
    sink(docs)
    number = F.col("id").cast("long")
    later = F.col("gatherTime") + F.make_dt_interval(F.lit(60))
    again = docs.filter(number % 3 == 0).withColumns({"category": F.lit("again"), "gatherTime": later})
    added = docs.withColumns({"id": F.concat(F.lit("new-"), "id"), "category": F.lit("new")})
    copies = docs.withColumns(
        {"id": F.lit("hot"), "category": F.col("id"), "gatherTime": F.lit(fx.GATHERED).cast("timestamp") + F.make_dt_interval(number.cast("int"))}
    )
    sink(again.unionByName(added).unionByName(copies))
    stored = snapshots.read_snapshot(spark, root)
    # Only the newest of the copies is left; its place in time depends on the number of documents.
    return stored.select("id", "domain", "category", F.date_format("gatherTime", "yyyy-MM-dd HH:mm:ss").alias("gathered"))


def _grown_store(spark: SparkSession, sf_dir: str) -> str:
    """A store of all documents and four deltas on it: rows written over, again, deleted, and written anew."""
    root = new_path(spark, "grown")
    docs = _docs(spark, sf_dir).select("id", "domain", "category")
    number = F.col("id").cast("long")
    snapshots.write_snapshot(docs, root)
    snapshots.write_delta(spark, root, docs.filter(number % 7 == 1).withColumn("category", F.lit("first")))
    snapshots.write_delta(spark, root, docs.filter((number % 7).isin(1, 2)).withColumn("category", F.lit("second")))
    snapshots.write_delta(spark, root, deleted=docs.filter(number % 11 == 0))
    snapshots.write_delta(spark, root, docs.filter(number % 33 == 0).withColumn("category", F.lit("again")))
    return root


def merged_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store between compactions."""
    return snapshots.read_snapshot(spark, _grown_store(spark, sf_dir))


def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a compaction, one more delta, and the expiry of what went before."""
    root = _grown_store(spark, sf_dir)
    snapshots.compact(spark, root)
    docs = _docs(spark, sf_dir).select("id", "domain", "category")
    last = docs.filter(F.col("id").cast("long") % 5 == 0)
    snapshots.write_delta(spark, root, last.withColumn("category", F.lit("last")))
    snapshots.expire(spark, root, keep=1)
    return snapshots.read_snapshot(spark, root)


def delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas and base files before and after compaction; a batch that changes nothing writes nothing."""
    root = _grown_store(spark, sf_dir)
    docs = _docs(spark, sf_dir).select("id", "domain", "category")
    snapshots.write_delta(spark, root, docs.limit(0))
    before = snapshots.delta_sizes(spark, root)
    snapshots.compact(spark, root, only_if_due=True)
    snapshots.compact(spark, root)
    after = snapshots.delta_sizes(spark, root)
    rows = [("before", before[0], before[1] > 0), ("after", after[0], after[1] > 0)]
    report = spark.createDataFrame(rows, "moment string, n_deltas int, has_delta_bytes boolean")
    return report.crossJoin(snapshots.read_snapshot(spark, root).agg(F.count("*").alias("n_rows")))


def keyed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank keys get a new one; keys known from the store or from earlier in the batch are reported."""
    docs = _docs(spark, sf_dir).select("id", "domain")
    number = F.col("id").cast("long")
    store = docs.filter(number % 2 == 0)
    new = docs.select(
        F.when(number % 5 == 0, F.lit(" ")).otherwise(F.col("id")).alias("id"), "domain", number.alias("number")
    )
    # Every seventh row comes again in the same batch.
    later = new.filter(F.col("number") % 7 == 0).withColumn("number", F.col("number") + 10_000_000)
    flagged = mutations.flag_duplicates(new.unionByName(later), store, version="number")
    return flagged.select("number", "is_duplicate", (F.length("id") == 36).alias("is_generated"))


def publish_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "messages")
    docs = _docs(spark, sf_dir).select("id", "domain", "title")
    sinks.publish_sink("text", path=path)(docs)
    return spark.read.text(path).withColumnRenamed("value", "message")


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents in three sinks, one of them switched off."""
    json_path, root, off = (new_path(spark, label) for label in ("json", "documents", "off"))
    docs = _docs(spark, sf_dir).drop("rawHTML")
    every = [sinks.json_sink(json_path), sinks.document_sink(root), sinks.publish_sink("text", enabled=False, path=off)]
    sinks.fan_out(docs, every)
    lines = spark.read.schema("id string").json(json_path).agg(F.count("*").alias("n")).withColumn("sink", F.lit("json"))
    rows = snapshots.read_snapshot(spark, root).agg(F.count("*").alias("n")).withColumn("sink", F.lit("store"))
    return lines.unionByName(rows)


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "export")
    docs = _docs(spark, sf_dir).select("id", "domain", "title", "rawHTML", "spiderUUID")
    exports.write_lines(exports.json_export(docs, F.col("spiderUUID") == "run-2", include_raw=False), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def export_json_with_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("id", "domain", "rawHTML")
    lines = exports.json_export(docs, F.col("domain") == "src4", include_raw=True)
    return lines.select("id", F.md5(F.get_json_object("value", "$.rawHTML")).alias("raw_md5"))


def export_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\n"), F.lit("<br/>")))
    lines = exports.title_content_export(docs, F.col("spiderUUID") == "run-2")
    path = new_path(spark, "pairs")
    exports.write_lines(lines, path)
    return spark.read.text(path).select(F.md5("value").alias("line_md5"))


QUERIES = {
    "a1_raw_pages": raw_pages,
    "a3_json_sink": json_sink,
    "a4_document_sink": document_sink,
    "a4_merged_on_read": merged_on_read,
    "a4_compacted_store": compacted_store,
    "a4_delta_report": delta_report,
    "a5_keyed_sink": keyed_sink,
    "a7_publish_sink": publish_sink,
    "a8_fan_out": fan_out,
    "a9_export_json": export_json,
    "a9_export_json_with_markup": export_json_with_markup,
    "a10_export_pairs": export_pairs,
}

_D = fx.with_sql(
    fx.DOCUMENTS_SQL,
    """t AS (SELECT id AS number, id::VARCHAR AS key, * EXCLUDE (id),
      CASE WHEN id % 5 <> 0 THEN substr(content, 1, 20) END AS title FROM docs)""",
)
_GROWN = """SELECT key AS id, domain, {category} AS category FROM t WHERE number % 33 = 0 OR number % 11 <> 0"""
_CATEGORY = "CASE WHEN number % 33 = 0 THEN 'again' WHEN number % 7 IN (1, 2) THEN 'second' ELSE category END"
_TITLE = """CASE WHEN title IS NULL THEN '' ELSE ',"title":' || to_json(title) END"""

CHECKS = {
    "a1_raw_pages": """SELECT url, md5(html) AS html_md5, NULL::INTEGER AS status, NULL::VARCHAR AS content_type FROM pages""",
    "a3_json_sink": _D + 'SELECT key AS id, domain, "spiderUUID", md5(content) AS content_md5 FROM t',
    "a4_document_sink": _D
    + """SELECT id, domain, category, strftime(written, '%Y-%m-%d %H:%M:%S') AS gathered FROM (
        SELECT key AS id, domain, CASE WHEN number % 3 = 0 THEN 'again' ELSE category END AS category,
          CASE WHEN number % 3 = 0 THEN "gatherTime" + INTERVAL 60 DAY ELSE "gatherTime" END AS written FROM t
        UNION ALL SELECT 'new-' || key, domain, 'new', "gatherTime" FROM t
        UNION ALL SELECT 'hot', domain, key, TIMESTAMP '2024-03-05 08:00:00' + to_days(number::INTEGER) FROM t
          WHERE number = (SELECT max(number) FROM t))""",
    "a4_merged_on_read": _D + _GROWN.format(category=_CATEGORY),
    "a4_compacted_store": _D
    + _GROWN.format(category=f"CASE WHEN number % 5 = 0 THEN 'last' ELSE {_CATEGORY} END")
    + " OR number % 5 = 0",
    "a4_delta_report": _D
    + f"""SELECT moment, n_deltas::INTEGER AS n_deltas, n_deltas > 0 AS has_delta_bytes, n_rows
        FROM (VALUES ('before', 4), ('after', 0)) v(moment, n_deltas),
          (SELECT count(*) AS n_rows FROM ({_GROWN.format(category="category")}))""",
    "a5_keyed_sink": _D
    + """SELECT number, number % 5 <> 0 AND number % 2 = 0 AS is_duplicate, number % 5 = 0 AS is_generated FROM t
        UNION ALL SELECT number + 10000000, number % 5 <> 0, number % 5 = 0 FROM t WHERE number % 7 = 0""",
    "a7_publish_sink": _D
    + f"""SELECT '{{"id":"' || key || '","domain":"' || domain || '"' || {_TITLE} || '}}' AS message FROM t""",
    "a8_fan_out": "SELECT count(*) AS n, 'json' AS sink FROM documents UNION ALL SELECT count(*), 'store' FROM documents",
    "a9_export_json": _D
    + f"""SELECT '{{"id":"' || key || '","domain":"' || domain || '"' || {_TITLE} || ',"spiderUUID":"run-2"}}' AS line FROM t
        WHERE "spiderUUID" = 'run-2'""",
    "a9_export_json_with_markup": _D
    + "SELECT key AS id, md5('<p>' || content) AS raw_md5 FROM t WHERE domain = 'src4'",
    "a10_export_pairs": _D
    + """SELECT md5(line) AS line_md5 FROM (
        SELECT unnest(string_split(coalesce(title, '') || ' ' || replace(content, chr(10), '<br/>'), chr(10))) AS line
        FROM t WHERE "spiderUUID" = 'run-2')""",
}
