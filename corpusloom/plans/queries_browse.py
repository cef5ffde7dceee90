"""Registered queries: looking at the document store, the catalogue and the task list."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import documents, listing, mutations, tasks
from corpusloom.plans import fixtures as fx
from corpusloom.session import new_path


def _shown(docs: DataFrame) -> DataFrame:
    gathered = F.date_format("gatherTime", "yyyy-MM-dd HH:mm:ss")
    return docs.select("id", "domain", "spiderUUID", gathered.alias("gathered"), F.md5("content").alias("content_md5"))


def of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(documents.of_run(fx.documents(spark, sf_dir), "run-3", 20, 2))


def of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(documents.of_domain(fx.documents(spark, sf_dir), "src5", 4, 2))


def of_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(documents.of_domains(fx.documents(spark, sf_dir), ["src1", "src2", "src7"], 25, 1))


def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(documents.by_id(fx.documents(spark, sf_dir), 42))


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(documents.newest(fx.documents(spark, sf_dir), 15, 3))


def browse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.documents(spark, sf_dir)
    return _shown(documents.browse(docs, matches=F.col("category") == "de", domain="src1", page=2))


def browse_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(documents.browse(fx.documents(spark, sf_dir), domain="src1"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.documents(spark, sf_dir)
    total = documents.count_all(docs).withColumn("counted", F.lit("all"))
    german = documents.count_all(docs, F.col("category") == "de").withColumn("counted", F.lit("de"))
    return total.unionByName(german)


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fx.documents(spark, sf_dir))


_NEWEST_FIRST = (("gatherTime", True), ("id", False))


def _listed(docs: DataFrame, by: str | None = None) -> listing.Listing:
    """``docs``, newest first, laid out and read again."""
    path = new_path(docs.sparkSession, "listing")
    listing.write_listing(docs, path, _NEWEST_FIRST, by)
    return listing.read_listing(docs.sparkSession, path)


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 15 in the middle of all documents."""
    newest_first = _listed(fx.documents(spark, sf_dir))
    return _shown(listing.page(newest_first, 15, listing.total(newest_first) // 30 + 1))


def deep_page_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of 4 of a domain, with the number of its documents."""
    by_domain = _listed(fx.documents(spark, sf_dir), "domain")
    total = listing.total(by_domain, "src5")
    return _shown(listing.page(by_domain, 4, max(1, -(-total // 4)), "src5")).withColumn("total", F.lit(total).cast("long"))


def resumed_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of 50 documents of a run, each read behind the cursor of the one before, the first behind
    the document in the middle."""
    by_run = _listed(fx.documents(spark, sf_dir), "spiderUUID")
    cursor, batches = None, []
    middle = listing.total(by_run, "run-3") // 2
    if middle:
        last_seen = listing.page(by_run, 1, middle, "run-3").select("gatherTime", "id")
        cursor = listing.cursor_of(by_run, last_seen)
    for number in (1, 2, 3):
        batch = listing.after(by_run, 50, cursor, "run-3")
        batches.append(_shown(batch).withColumn("batch", F.lit(number)))
        last = batch.select("cursor").tail(1)
        if not last:
            break
        cursor = last[0]["cursor"]
    return reduce(DataFrame.unionByName, batches)


def _task(events: DataFrame) -> DataFrame:
    return events.select("event_id", "task_id", "state", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def tasks_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _task(tasks.by_state(fx.task_events(spark, sf_dir), "STOP", with_extra=False))


def tasks_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.lit(datetime(2024, 1, day)).cast("timestamp") for day in (10, 12))
    return _task(tasks.by_time(fx.task_events(spark, sf_dir), start, end))


def tasks_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.count_by_state(fx.task_events(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


def catalogue_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).filter(F.col("p_brand") == "Brand#4")


def catalogue_find_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.find_one(_parts(spark, sf_dir), F.col("p_brand") == "Brand#4", [F.col("p_partkey").desc()])


def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.page_with_total(_parts(spark, sf_dir), [F.col("p_name"), F.col("p_partkey")], 30, 4)


def catalogue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.count_all(_parts(spark, sf_dir), F.col("p_size") > 25)


def catalogue_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.delete_where(_parts(spark, sf_dir), F.col("p_brand") == "Brand#4")


def catalogue_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save every third part again under a new name, and as many new parts."""
    parts = _parts(spark, sf_dir).withColumn("version", F.lit(1))
    third = parts.filter(F.col("p_partkey") % 3 == 0).withColumn("version", F.lit(2))
    renamed = third.withColumn("p_name", F.concat(F.lit("new "), "p_name"))
    added = third.withColumn("p_partkey", -F.col("p_partkey") - 1)
    saved = mutations.upsert(parts, renamed.unionByName(added), "p_partkey", "version")
    return saved.select("p_partkey", "p_name", "version")


def catalogue_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set the size of one brand to null (changes nothing) and its name to upper case, for some parts once
    more and later to another name; unknown parts come too."""
    parts = _parts(spark, sf_dir)
    size = F.lit(None).cast("int").alias("p_size")
    first = parts.filter(F.col("p_brand") == "Brand#4").select("p_partkey", F.upper("p_name").alias("p_name"), size)
    second = first.filter(F.col("p_partkey") % 3 == 0).withColumn("p_name", F.concat("p_name", F.lit("!")))
    unknown = first.withColumn("p_partkey", -F.col("p_partkey") - 1)
    turns = [x.withColumn("turn", F.lit(i)) for i, x in enumerate((first, second, unknown))]
    updates = turns[0].unionByName(turns[1]).unionByName(turns[2])
    return mutations.partial_update(parts, updates, "p_partkey", "turn")


QUERIES = {
    "b1_documents_of_run": of_run,
    "b2_documents_of_domain": of_domain,
    "b3_documents_of_domains": of_domains,
    "b4_document_by_id": by_id,
    "b5_newest_documents": newest,
    "b6_browse_by_search": browse_search,
    "b6_browse_by_domain": browse_domain,
    "b8_counts": counts,
    "b9_tasks_by_state": tasks_by_state,
    "b9_tasks_by_time": tasks_by_time,
    "b9_tasks_count": tasks_count,
    "b5_deep_page": deep_page,
    "b2_deep_page_of_domain": deep_page_of_domain,
    "a11_full_scan": full_scan,
    "a11_resumed_scroll": resumed_scroll,
    "a12_catalogue_find": catalogue_find,
    "a12_catalogue_find_one": catalogue_find_one,
    "a12_catalogue_page": catalogue_page,
    "a12_catalogue_count": catalogue_count,
    "a12_catalogue_delete": catalogue_delete,
    "a12_catalogue_save": catalogue_save,
    "a12_catalogue_update": catalogue_update,
}

_SHOWN = """SELECT id, domain, "spiderUUID", strftime("gatherTime", '%Y-%m-%d %H:%M:%S') AS gathered,
  md5(content) AS content_md5 FROM docs """
_D = fx.with_sql(fx.DOCUMENTS_SQL)
_T = fx.with_sql(fx.TASK_EVENTS_SQL)
_NEWEST = ' ORDER BY "gatherTime" DESC, id '
_TASK = "SELECT event_id, task_id, state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM task_events "
_PART = "SELECT p_partkey, p_name, p_brand, p_size FROM part "

CHECKS = {
    "b1_documents_of_run": _D + _SHOWN + """WHERE "spiderUUID" = 'run-3' ORDER BY id LIMIT 20 OFFSET 20""",
    "b2_documents_of_domain": _D + _SHOWN + "WHERE domain = 'src5'" + _NEWEST + "LIMIT 4 OFFSET 4",
    "b3_documents_of_domains": _D + _SHOWN + "WHERE domain IN ('src1', 'src2', 'src7')" + _NEWEST + "LIMIT 25",
    "b4_document_by_id": _D + _SHOWN + "WHERE id = 42",
    "b5_newest_documents": _D + _SHOWN + _NEWEST + "LIMIT 15 OFFSET 30",
    "b6_browse_by_search": _D + _SHOWN + "WHERE category = 'de'" + _NEWEST + "LIMIT 10 OFFSET 10",
    "b6_browse_by_domain": _D + _SHOWN + "WHERE domain = 'src1'" + _NEWEST + "LIMIT 10",
    "b8_counts": """SELECT count(*) AS n, 'all' AS counted FROM documents
        UNION ALL SELECT count(*), 'de' FROM documents WHERE lang = 'de'""",
    "b9_tasks_by_state": _T + _TASK + "WHERE state = 'STOP'",
    "b9_tasks_by_time": _T + _TASK + "WHERE ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'",
    "b9_tasks_count": _T + "SELECT state, count(*) AS n FROM task_events GROUP BY state",
    "b5_deep_page": _D + _SHOWN + _NEWEST + "LIMIT 15 OFFSET (SELECT 15 * (count(*) // 30) FROM docs)",
    "b2_deep_page_of_domain": _D + """, own AS (SELECT *, count(*) OVER () AS total,
          row_number() OVER (ORDER BY "gatherTime" DESC, id) AS nth FROM docs WHERE domain = 'src5')
        SELECT id, domain, "spiderUUID", strftime("gatherTime", '%Y-%m-%d %H:%M:%S') AS gathered,
          md5(content) AS content_md5, total FROM own WHERE nth > (total - 1) // 4 * 4""",
    "a11_full_scan": _D + _SHOWN,
    "a11_resumed_scroll": _D + """, own AS (SELECT *, count(*) OVER () AS total,
          row_number() OVER (ORDER BY "gatherTime" DESC, id) AS nth FROM docs WHERE "spiderUUID" = 'run-3')
        SELECT id, domain, "spiderUUID", strftime("gatherTime", '%Y-%m-%d %H:%M:%S') AS gathered,
          md5(content) AS content_md5, CAST((nth - total // 2 - 1) // 50 + 1 AS INTEGER) AS batch
        FROM own WHERE nth > total // 2 AND nth <= total // 2 + 150""",
    "a12_catalogue_find": _PART + "WHERE p_brand = 'Brand#4'",
    "a12_catalogue_find_one": _PART + "WHERE p_brand = 'Brand#4' ORDER BY p_partkey DESC LIMIT 1",
    "a12_catalogue_page": """SELECT p_partkey, p_name, p_brand, p_size, (SELECT count(*) FROM part) AS total FROM part
        ORDER BY p_name, p_partkey LIMIT 30 OFFSET 90""",
    "a12_catalogue_count": "SELECT count(*) AS n FROM part WHERE p_size > 25",
    "a12_catalogue_delete": _PART + "WHERE p_brand <> 'Brand#4'",
    "a12_catalogue_save": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name,
        CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM part
        UNION ALL SELECT -p_partkey - 1, p_name, 2 FROM part WHERE p_partkey % 3 = 0""",
    "a12_catalogue_update": """SELECT p_partkey, CASE WHEN p_brand <> 'Brand#4' THEN p_name
          WHEN p_partkey % 3 = 0 THEN upper(p_name) || '!' ELSE upper(p_name) END AS p_name,
        p_brand, p_size FROM part""",
}
