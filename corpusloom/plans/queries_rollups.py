"""Registered queries: counts, histograms, facets, changes to the store, and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import aggregates, mutations, tasks, text_analysis
from corpusloom.plans import fixtures as fx
from corpusloom.plans.queries_text import GAZETTEER_SQL, gazetteer
from corpusloom.session import new_path, spread
from corpusloom.sources import snapshots


def docs_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.docs_per_domain(fx.documents(spark, sf_dir), 15)


def pages_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("domain"))
    return aggregates.docs_per_domain(pages)


def words_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.words_of_domain(fx.documents(spark, sf_dir), "src3")


def daily_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("domain"),
        F.col("ts").alias("gatherTime"),
    )
    days = aggregates.daily_histogram(events, "click/5")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_docs")


def related_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the documents of the domain are analysed; the corpus gives the frequencies of their terms."""
    found = fx.documents(spark, sf_dir).filter(F.col("domain") == "src3")
    texts = spread(found.select("id", "content"))
    names = text_analysis.named_entities(texts, gazetteer(spark, sf_dir))
    words = text_analysis.keywords(texts, corpus=fx.texts(spark, sf_dir))
    return aggregates.related_facets(found.join(names, "id", "left").join(words, "id", "left"), F.lit(True))


def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.related_documents(fx.documents(spark, sf_dir), F.col("domain") == "src3", 12)
    return found.select("id", "domain")


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.task_events(spark, sf_dir).select(
        F.col("task_id").alias("run_id"), "event_id", "ts", "state", (F.col("value") > 5).alias("effective")
    )
    return tasks.run_progress(events).select(
        "run_id", "n_pages", "n_effective", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "state"
    )


def _messages(spark: SparkSession, sf_dir: str, shrink: int) -> DataFrame:
    """Events as log messages; the time between them divided so that entries really merge."""
    return fx.table(spark, sf_dir, "events").select(
        F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"),
        F.col("event_id").alias("seq"),
        F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000) / shrink).alias("ts_ms"),
        F.col("event_type").alias("message"),
    )


def coalesced_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.coalesce_log(_messages(spark, sf_dir, 20000))


def coalesced_hot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in one task."""
    messages = _messages(spark, sf_dir, 500).withColumn("task_id", F.lit("only"))
    return tasks.coalesce_log(messages).select("task_id", "anchor_ms", "n_messages", F.md5("text").alias("text_md5"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    root = new_path(spark, "documents")
    docs = fx.documents(spark, sf_dir).select("id", "domain", "category", F.length("content").cast("long").alias("n"))
    snapshots.write_snapshot(docs, root)
    return root, docs


def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, docs = _stored(spark, sf_dir)
    gone = docs.filter(F.col("n") < 100).select("id")
    return snapshots.change(spark, root, lambda store: mutations.delete_keys(store, gone), gone)


def delete_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _stored(spark, sf_dir)
    gone = F.col("domain") == "src3"
    touched = snapshots.read_snapshot(spark, root).filter(gone).select("id")
    return snapshots.change(spark, root, lambda store: mutations.delete_where(store, gone), touched)


def delete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a delete meant, and whether it found any, for a domain that is there and one that isn't."""
    _, docs = _stored(spark, sf_dir)
    reports = [
        mutations.affected(docs, F.col("domain") == name).withColumn("domain", F.lit(name)) for name in ("src3", "none")
    ]
    return reports[0].unionByName(reports[1])


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, docs = _stored(spark, sf_dir)
    updates = docs.filter(F.col("domain").isin("src1", "src2")).select(
        "id", F.lit(None).cast("string").alias("domain"), F.upper("category").alias("category"), F.lit(1).alias("turn")
    )
    # Some come twice, the later one with a domain and without a category; others aren't stored.
    again = updates.filter(F.col("id") % 4 == 0).withColumns(
        {"domain": F.lit("moved"), "category": F.lit(None).cast("string"), "turn": F.lit(2)}
    )
    unknown = updates.withColumn("id", -F.col("id") - 1)
    every = updates.unionByName(again).unionByName(unknown)
    return snapshots.change(spark, root, lambda store: mutations.partial_update(store, every, version="turn"), every)


def retained_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = tasks.latest_states(fx.task_events(spark, sf_dir))
    return tasks.retained(latest).select("task_id", "state")


def deletion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.task_events(spark, sf_dir)
    requested = events.select(
        F.when(F.col("event_id") % 50 == 0, F.concat("task_id", F.lit("-x"))).otherwise(F.col("task_id")).alias("task_id")
    )
    return tasks.deletion_verdicts(tasks.latest_states(events), requested)


def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = tasks.latest_states(fx.task_events(spark, sf_dir))
    return latest.select("task_id", "state", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.transitions(fx.task_events(spark, sf_dir)).drop("ts")


QUERIES = {
    "h1_docs_per_domain": docs_per_domain,
    "h1_pages_per_host": pages_per_host,
    "h2_words_of_domain": words_of_domain,
    "h3_daily_histogram": daily_histogram,
    "h4_related_facets": related_facets,
    "h4_related_documents": related_documents,
    "h5_run_progress": run_progress,
    "h6_coalesced_log": coalesced_log,
    "h6_coalesced_hot_log": coalesced_hot_log,
    "h7_delete_by_id": delete_by_id,
    "h8_delete_by_domain": delete_by_domain,
    "h8_delete_report": delete_report,
    "h9_partial_update": partial_update,
    "h10_retained_tasks": retained_tasks,
    "h10_deletion_verdicts": deletion_verdicts,
    "h11_latest_states": latest_states,
    "h11_transitions": transitions,
}

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS r FROM task_events) WHERE r = 1)"""


def _log(shrink: int, task: str, text: str) -> str:
    """Anchors one after the other: the next is the first message two seconds or more after the last."""
    return f"""WITH RECURSIVE m AS (
      SELECT {task} AS task_id, event_id AS seq, event_type AS message,
             (epoch_us(ts) // 1000 - 1704067200000) // {shrink} AS ts_ms FROM events),
    anchors AS (
      SELECT task_id, min(ts_ms) AS anchor_ms FROM m GROUP BY task_id
      UNION ALL
      SELECT a.task_id, (SELECT min(ts_ms) FROM m WHERE m.task_id = a.task_id AND m.ts_ms >= a.anchor_ms + 2000)
      FROM anchors a WHERE a.anchor_ms IS NOT NULL),
    placed AS (
      SELECT m.*, a.anchor_ms FROM m ASOF JOIN (SELECT * FROM anchors WHERE anchor_ms IS NOT NULL) a
      ON m.task_id = a.task_id AND m.ts_ms >= a.anchor_ms)
    SELECT task_id, anchor_ms, count(*) AS n_messages, {text} FROM placed GROUP BY task_id, anchor_ms"""


_JOINED = "string_agg(message, '<br/>' ORDER BY ts_ms, seq)"

CHECKS = {
    "h1_docs_per_domain": """SELECT * FROM (SELECT source AS domain, count(*) AS n_docs FROM documents GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 15) WHERE length(domain) > 1""",
    "h1_pages_per_host": r"""SELECT * FROM (SELECT regexp_extract(url, '^\w+://([^/:?#]+)', 1) AS domain,
        count(*) AS n_docs FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) WHERE length(domain) > 1""",
    "h2_words_of_domain": fx.with_sql(fx.DOCUMENTS_SQL)
    + f"""SELECT * FROM (SELECT word, count(DISTINCT id) AS n_docs FROM (
        SELECT id, unnest({fx.TOKENS_SQL}) AS word FROM docs WHERE domain = 'src3') GROUP BY word
        ORDER BY 2 DESC, 1 LIMIT 200) WHERE length(word) > 1""",
    "h3_daily_histogram": """WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM events
        WHERE event_type = 'click' AND user_id = 5 GROUP BY 1)
        SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n_docs
        FROM (SELECT unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS d)
        LEFT JOIN c ON c.day = d::DATE""",
    "h4_related_facets": fx.with_sql(fx.DOCUMENTS_SQL, GAZETTEER_SQL)
    + """, tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2),
      ranked AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY
          round(tf * ln(1 + (SELECT count(*) FROM docs) / df::DOUBLE), 6) DESC, term) AS r
        FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) USING (term)),
      keys AS (
        SELECT CASE type WHEN 'nr' THEN 'relatedPeople' WHEN 'ns' THEN 'relatedLocation' ELSE 'relatedInstitution' END
          AS facet, surface AS key, id FROM mentions
        UNION ALL SELECT 'relatedKeywords', term, id FROM ranked WHERE r <= 10),
      counted AS (SELECT facet, key, count(DISTINCT id) AS n_docs FROM keys JOIN docs USING (id)
        WHERE domain = 'src3' GROUP BY 1, 2)
      SELECT facet, key, n_docs FROM (SELECT *, row_number() OVER (
        PARTITION BY facet ORDER BY n_docs DESC, key) AS r FROM counted) WHERE r <= 10""",
    "h4_related_documents": fx.with_sql(fx.DOCUMENTS_SQL)
    + """SELECT id, domain FROM docs WHERE domain = 'src3' ORDER BY "gatherTime" DESC, id LIMIT 12""",
    "h5_run_progress": fx.with_sql(fx.TASK_EVENTS_SQL, _LATEST)
    + """SELECT task_id AS run_id, count(*) AS n_pages, count(*) FILTER (e.value > 5) AS n_effective,
        strftime(min(e.ts), '%Y-%m-%d %H:%M:%S') AS started, any_value(l.state) AS state
        FROM task_events e JOIN latest l USING (task_id) GROUP BY task_id""",
    "h6_coalesced_log": _log(20000, "'task-' || user_id", f"{_JOINED} AS text"),
    "h6_coalesced_hot_log": _log(500, "'only'", f"md5({_JOINED}) AS text_md5"),
    "h7_delete_by_id": """SELECT doc_id AS id, source AS domain, lang AS category, length(text) AS n
        FROM documents WHERE length(text) >= 100""",
    "h8_delete_by_domain": """SELECT doc_id AS id, source AS domain, lang AS category, length(text) AS n
        FROM documents WHERE source <> 'src3'""",
    "h8_delete_report": """SELECT count(*) AS n_affected, count(*) > 0 AS found, 'src3' AS domain FROM documents WHERE source = 'src3'
        UNION ALL SELECT 0, false, 'none'""",
    "h9_partial_update": """SELECT doc_id AS id,
        CASE WHEN source IN ('src1', 'src2') AND doc_id % 4 = 0 THEN 'moved' ELSE source END AS domain,
        CASE WHEN source IN ('src1', 'src2') THEN upper(lang) ELSE lang END AS category, length(text) AS n FROM documents""",
    "h10_retained_tasks": fx.with_sql(fx.TASK_EVENTS_SQL, _LATEST)
    + "SELECT task_id, state FROM latest WHERE state <> 'STOP'",
    "h10_deletion_verdicts": fx.with_sql(fx.TASK_EVENTS_SQL, _LATEST)
    + """SELECT DISTINCT r.task_id, CASE WHEN l.state IS NULL THEN 'unknown' WHEN l.state = 'STOP' THEN 'deleted'
        ELSE 'refused' END AS verdict
        FROM (SELECT CASE WHEN event_id % 50 = 0 THEN task_id || '-x' ELSE task_id END AS task_id FROM task_events) r
        LEFT JOIN latest l USING (task_id)""",
    "h11_latest_states": fx.with_sql(fx.TASK_EVENTS_SQL, _LATEST)
    + "SELECT task_id, state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM latest",
    "h11_transitions": fx.with_sql(fx.TASK_EVENTS_SQL)
    + """SELECT task_id, event_id, state, previous, coalesce(CASE state WHEN 'INIT' THEN previous IS NULL
        WHEN 'RUNNING' THEN previous = 'INIT' WHEN 'STOP' THEN previous = 'RUNNING' END, false) AS is_legal
        FROM (SELECT *, lag(state) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS previous FROM task_events)""",
}
