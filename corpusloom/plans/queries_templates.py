"""Registered queries: reading, checking, storing and choosing templates.

The templates are those of the hosts of ``pages``, written as JSON the way template files are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import extraction, mutations, template_admin
from corpusloom.plans import fixtures as fx
from corpusloom.plans import queries_extraction
from corpusloom.session import new_path
from corpusloom.sources import snapshots
from corpusloom.sources.templates import parse_templates


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and flags as text, blank rules, an unknown key; the faults follow from the host's hash."""
    templates = fx.hosts(spark, sf_dir).join(fx.templates(spark, sf_dir).drop("siteName"), F.col("host") == F.col("domain"))
    h = F.col("h")
    fields = F.struct(
        F.col("id"),
        F.when(h == 13, F.lit(" ")).otherwise(F.col("host")).alias("siteName"),
        F.when(h == 12, F.concat("host", F.lit("/x"))).otherwise(F.col("host")).alias("domain"),
        F.when(h == 10, F.expr("cast(array() as array<string>)")).otherwise(F.array("first_url")).alias("startURL"),
        F.when(h == 1, F.lit("<h1>(")).otherwise(F.coalesce("titleReg", F.lit(""))).alias("titleReg"),
        F.col("timeout").cast("string").alias("timeout"),
        F.when(h != 7, F.lit("2")).otherwise(F.lit("0")).alias("thread"),
        F.when(h % 2 == 0, F.lit("true")).alias("needTitle"),
        F.array(
            F.struct(
                F.when(h == 5, F.lit("")).otherwise(F.lit("owner")).alias("name"),
                F.when(h == 3, F.lit("")).otherwise(F.lit("x")).alias("regex"),
                F.when(h == 2, F.lit("//a[last()]")).when(h == 4, F.lit("//h1/text()")).otherwise(F.lit("")).alias("xpath"),
                F.lit("true").alias("need"),
            )
        ).alias("dynamicFields"),
        F.lit("left out").alias("unknownKey"),
    )
    return templates.select(F.to_json(fields).alias("value"), "host", "h")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_templates(_json(spark, sf_dir), "value")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one file of lines, read back, parsed."""
    path = new_path(spark, "templates")
    _json(spark, sf_dir).select("value").write.text(path)
    found = parse_templates(spark.read.text(path), "value")
    return found.select(
        "id", "siteName", "domain", "titleReg", "timeout", "thread", "retry", "maxPageGather", "needTitle",
        "saveCapture", F.col("dynamicFields")[0]["need"].alias("first_need"),
    )


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_admin.validate(_parsed(spark, sf_dir))
    return found.select("id", F.array_join("violations", ",").alias("violations"))


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates of some hashes come again under new ids, those of another with another time limit."""
    stored = _parsed(spark, sf_dir)
    h = F.instr(F.lit(fx.HEX_DIGITS), F.substring("id", 5, 1)) - 1
    changed = stored.withColumn("timeout", F.when(h % 3 == 0, F.lit(9000)).otherwise(F.col("timeout")))
    incoming = changed.withColumn("id", F.concat(F.lit("new-"), F.col("id"))).unionByName(
        stored.withColumn("id", F.concat(F.lit("newer-"), F.col("id")))
    )
    return template_admin.known_ids(incoming, stored).select("id", "domain", "timeout", "is_new")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "templates")
    stored = _parsed(spark, sf_dir).select("id", "domain", "timeout", "titleReg")
    snapshots.write_snapshot(stored, root)
    h = F.instr(F.lit(fx.HEX_DIGITS), F.substring("id", 5, 1)) - 1
    rows = stored.filter(h < 8).select(
        F.when(h % 2 == 0, F.col("id")).otherwise(F.lit(" ")).alias("id"),
        F.concat(F.lit("www."), F.col("domain")).alias("domain"),
        F.lit(7000).alias("timeout"),
        F.lit(None).cast("string").alias("titleReg"),
    )
    # Of the templates of one hash a second update comes later, those of another have ids that aren't stored.
    again = rows.filter(h == 4).withColumns({"timeout": F.lit(8000), "domain": F.lit(None).cast("string")})
    unknown = stored.filter(h == 9).select(
        F.concat(F.lit("zz-"), "id").alias("id"), "domain", F.lit(7500).alias("timeout"), "titleReg"
    )
    every = rows.unionByName(again).unionByName(unknown)
    new_id = F.concat(F.lit("made-"), F.md5("domain"))
    return snapshots.change(
        spark, root, lambda store: mutations.insert_or_update(store, every, new_id, version="timeout")
    )


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template deleted by id, those of one host by domain."""
    root = new_path(spark, "templates")
    stored = _parsed(spark, sf_dir).select("id", "domain")
    snapshots.write_snapshot(stored, root)
    first = stored.agg(F.min("id").alias("id"))
    last = stored.agg(F.max("domain").alias("domain"))
    snapshots.change(spark, root, lambda store: mutations.delete_keys(store, first))
    return snapshots.change(spark, root, lambda store: mutations.delete_keys(store, last, "domain"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("h") % 4 == 1, "RUNNING").otherwise("STOP")
    return fx.hosts(spark, sf_dir).select(F.concat(F.lit("tpl-"), F.md5("host")).alias("template_id"), state.alias("state"))


def not_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_admin.not_running(_parsed(spark, sf_dir), _tasks(spark, sf_dir)).select("id", "domain")


def start_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _parsed(spark, sf_dir)
    ids = stored.select("id").unionByName(stored.select(F.concat("id", F.lit("-gone")).alias("id")))
    return template_admin.start_batch(stored, ids, _tasks(spark, sf_dir)).select("id", "domain")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_admin.list_templates(_parsed(spark, sf_dir), 10, 2).select("id", "domain")


def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template of the first host."""
    stored = _parsed(spark, sf_dir)
    wanted = stored.agg(F.min("id")).first()[0]
    return template_admin.template_by_id(stored, wanted).select("id", "domain", "timeout")


def of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates of the host with the most pages."""
    busiest = fx.hosts(spark, sf_dir).orderBy(F.col("n_pages").desc(), "host").first()["host"]
    return template_admin.templates_of_domain(_parsed(spark, sf_dir), busiest, 10, 1).select("id", "domain")


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = extraction.preview(fx.pages(spark, sf_dir), fx.templates(spark, sf_dir), fx.GATHERED)
    return seen.select("url", "title", "category", "spiderUUID")


QUERIES = {
    "a2_parsed_templates": parsed,
    "b7_templates_listed": listed,
    "b7_templates_of_domain": of_domain,
    "b7_template_by_id": by_id,
    "c1_violations": violations,
    "c2_known_ids": known_ids,
    "c3_upserted": upserted,
    "c4_deleted": deleted,
    "c5_not_running": not_running,
    "c6_start_batch": start_batch,
    "c7_preview": previewed,
}

_T = fx.HOSTS_SQL + """,
t AS (
  SELECT 'tpl-' || md5(host) AS id, host, h, CASE WHEN h = 13 THEN NULL ELSE host END AS "siteName",
         CASE WHEN h = 12 THEN host || '/x' ELSE host END AS domain,
         CASE WHEN h = 1 THEN '<h1>(' WHEN h % 2 = 0 THEN '<h1>(.*?)</h1>' END AS "titleReg",
         CASE WHEN h = 11 THEN 500 ELSE 5000 END AS timeout, CASE WHEN h = 7 THEN 0 ELSE 2 END AS thread,
         concat_ws(',', CASE WHEN h = 10 THEN 'no_start_url' END, CASE WHEN h = 12 THEN 'slash_in_domain' END,
           CASE WHEN h = 7 THEN 'no_thread' END, CASE WHEN h = 13 THEN 'blank_site_name' END,
           CASE WHEN h = 11 THEN 'short_timeout' END, CASE WHEN h = 5 OR h = 3 THEN 'bad_dynamic_field' END,
           CASE WHEN h = 1 THEN 'bad_regex' END, CASE WHEN h = 2 THEN 'bad_path_rule' END) AS violations
  FROM hosts)"""
_W = fx.with_sql(_T)
_PREVIEW = fx.with_sql(*queries_extraction._ALL)

CHECKS = {
    "a2_parsed_templates": _W
    + """SELECT id, "siteName", domain, "titleReg", timeout, thread, 2 AS retry, 10 AS "maxPageGather",
        h % 2 = 0 AS "needTitle", true AS "saveCapture", true AS first_need FROM t""",
    "b7_templates_listed": _W + "SELECT id, domain FROM t ORDER BY id LIMIT 10 OFFSET 10",
    "b7_templates_of_domain": _W
    + "SELECT id, domain FROM t WHERE domain = (SELECT host FROM hosts ORDER BY n_pages DESC, host LIMIT 1)",
    "b7_template_by_id": _W + "SELECT id, domain, timeout FROM t ORDER BY id LIMIT 1",
    "c1_violations": _W + "SELECT id, violations FROM t",
    "c2_known_ids": _W
    + """SELECT id, domain, timeout, false AS is_new FROM t
        UNION ALL SELECT 'new-' || id, domain, 9000, true FROM t WHERE h % 3 = 0""",
    "c3_upserted": _W
    + """SELECT id, CASE WHEN h < 8 AND h % 2 = 0 THEN 'www.' || domain ELSE domain END AS domain,
          CASE WHEN h = 4 THEN 8000 WHEN h < 8 AND h % 2 = 0 THEN 7000 ELSE timeout END AS timeout, "titleReg" FROM t
        UNION ALL SELECT 'zz-' || id, domain, 7500, "titleReg" FROM t WHERE h = 9
        UNION ALL SELECT 'made-' || md5('www.' || domain), 'www.' || domain, 7000, NULL FROM t WHERE h < 8 AND h % 2 = 1""",
    "c4_deleted": _W
    + """SELECT id, domain FROM t WHERE id <> (SELECT min(id) FROM t) AND domain <> (SELECT max(domain) FROM t)""",
    "c5_not_running": _W + "SELECT id, domain FROM t WHERE h % 4 <> 1",
    "c7_preview": _PREVIEW + """SELECT url, title, category, 'preview' AS "spiderUUID" FROM d""",
    "c6_start_batch": _W + "SELECT id, domain FROM t WHERE h % 4 <> 1 AND violations = ''",
}
