"""Registered queries: tokens, keywords, summaries and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markup, tokens
from corpusloom.functions.values import let
from corpusloom.operators import text_analysis
from corpusloom.plans import fixtures as fx
from corpusloom.session import new_path, shuffles_dropped

# A gazetteer made from the corpus, which grows with it: the words and pairs of words of so many documents or more
# whose hash begins with one of three digits, one for each type.
NAME_DOCUMENTS = 10
NAME_TYPES = {"0": "nr", "1": "ns", "2": "nt"}


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.texts(spark, sf_dir)
    words = tokens.tokens(F.col("content"))
    digit = F.substring(F.md5("surface"), 1, 1)

    def frequent(terms: Column) -> DataFrame:
        listed = found.select(F.explode(F.array_distinct(terms)).alias("surface")).filter(digit.isin(*NAME_TYPES))
        return listed.groupBy("surface").agg(F.count("*").alias("n")).filter(F.col("n") >= NAME_DOCUMENTS).select("surface")

    kind = F.create_map(*(F.lit(part) for pair in NAME_TYPES.items() for part in pair))[digit]
    both = frequent(words).unionByName(frequent(let(words, lambda w: tokens.grams(w, 2))))
    path = new_path(spark, "gazetteer")
    with shuffles_dropped(spark):
        both.select("surface", kind.alias("type")).write.parquet(path)
    return spark.read.parquet(path)


GAZETTEER_SQL = rf"""words AS (
  SELECT id, unnest(parts) AS term, generate_subscripts(parts, 1) AS pos
  FROM (SELECT id, {fx.TOKENS_SQL} AS parts FROM docs)),
pairs AS (SELECT id, term || ' ' || lead(term) OVER (PARTITION BY id ORDER BY pos) AS term FROM words),
names AS (
  SELECT term AS surface, CASE substr(md5(term), 1, 1) WHEN '0' THEN 'nr' WHEN '1' THEN 'ns' ELSE 'nt' END AS type FROM (
    SELECT id, term FROM words UNION ALL SELECT id, term FROM pairs WHERE term IS NOT NULL)
  WHERE substr(md5(term), 1, 1) IN ('0', '1', '2') GROUP BY term HAVING count(DISTINCT id) >= {NAME_DOCUMENTS}),
mentions AS (
  SELECT DISTINCT id, type, surface FROM (SELECT id, term FROM words UNION ALL SELECT id, term FROM pairs) g
  JOIN names ON names.surface = g.term)"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.texts(spark, sf_dir).select("id", tokens.tokens(F.col("content")).alias("t"))
    return found.select(
        "id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_terms"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_analysis.keywords(fx.texts(spark, sf_dir))
    return found.select("id", F.array_join("keywords", " ").alias("keywords"))


def _with_lone_words(docs: DataFrame) -> DataFrame:
    first = F.get(tokens.tokens(F.col("content")), 0)
    lone = docs.filter(F.col("id") % 10 == 0).select(
        (-F.col("id") - 1).alias("id"), F.concat_ws(" ", first, first, first).alias("content")
    )
    return docs.unionByName(lone)


def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds, over every term of every document."""
    scored = text_analysis.rank_scores(_with_lone_words(fx.texts(spark, sf_dir)), rounds=2)
    # Two rounds give short decimals; the shift keeps those that end in 5 on one side.
    return scored.select("id", "term", F.round(F.col("score") + 1e-9, 6).alias("score"))


def rank_all_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rounds as the operator runs if it isn't told otherwise."""
    scored = text_analysis.rank_scores(_with_lone_words(fx.texts(spark, sf_dir)))
    return scored.select("id", "term", F.round(F.col("score") + 1e-9, 6).alias("score"))


def rank_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and, from each tenth of them, one that says its first word over and over."""
    found = text_analysis.rank_keywords(_with_lone_words(fx.texts(spark, sf_dir)), rounds=2)
    return found.select("id", F.array_join("keywords", " ").alias("keywords"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_analysis.summaries(fx.texts(spark, sf_dir))
    return found.select("id", F.array_join("summary", " | ").alias("summary"))


def _names_of(mentions: DataFrame) -> DataFrame:
    return mentions.select("id", *(F.array_join(f"namedEntity.{kind}", "/").alias(kind) for kind in ("nr", "ns", "nt")))


def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names_of(text_analysis.named_entities(fx.texts(spark, sf_dir), gazetteer(spark, sf_dir)))


def named_entities_by_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the gazetteer is too large to broadcast."""
    return _names_of(text_analysis.named_entities(fx.texts(spark, sf_dir), gazetteer(spark, sf_dir), few=False))


def plain_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    article = markup.clean_body(F.regexp_extract("html", fx.BODY_RULE, 1))
    return fx.pages(spark, sf_dir).select("url", text_analysis.plain_content(article).alias("text"))


QUERIES = {
    "f1_tokens": token_counts,
    "f2_keywords": keywords,
    "f3_rank_scores": rank_scores,
    "f3_rank_all_rounds": rank_all_rounds,
    "f3_rank_keywords": rank_keywords,
    "f4_summaries": summaries,
    "f5_named_entities": named_entities,
    "f5_entities_by_shuffle": named_entities_by_shuffle,
    "f6_plain_content": plain_content,
}

_D = fx.DOCUMENTS_SQL
_WORDS = f"""words AS (
  SELECT id, unnest(parts) AS term, generate_subscripts(parts, 1) AS pos
  FROM (SELECT id, {fx.TOKENS_SQL} AS parts FROM docs))"""
_DF = """n AS (SELECT count(*)::DOUBLE AS n FROM docs),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


_RANKED_WORDS = f"""words AS (
  SELECT id, term, pos FROM (SELECT id, unnest(parts) AS term, generate_subscripts(parts, 1) AS pos
    FROM (SELECT id, {fx.TOKENS_SQL} AS parts FROM docs))
  UNION ALL SELECT -id - 1, ({fx.TOKENS_SQL})[1], unnest([1, 2, 3]) FROM docs
    WHERE id % 10 = 0 AND len({fx.TOKENS_SQL}) > 0)"""


def _rank_round(number: int) -> str:
    return f"""s{number} AS MATERIALIZED (SELECT e.id, e.neighbour AS term, 0.15 + 0.85 * sum(s.score / g.degree) AS score
      FROM edges e JOIN s{number - 1} s USING (id, term) JOIN degrees g USING (id, term) GROUP BY 1, 2)"""


def _ranked(rounds: int) -> str:
    return fx.with_sql(
        _D,
        _RANKED_WORDS,
        """pairs AS (SELECT DISTINCT a.id, a.term, b.term AS neighbour FROM words a JOIN words b
          ON a.id = b.id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 WHERE a.term <> b.term)""",
        "edges AS MATERIALIZED (SELECT id, term, neighbour FROM pairs UNION SELECT id, neighbour, term FROM pairs)",
        "degrees AS MATERIALIZED (SELECT id, term, count(*) AS degree FROM edges GROUP BY 1, 2)",
        "s0 AS (SELECT id, term, 1.0::DOUBLE AS score FROM degrees)",
        *map(_rank_round, range(1, rounds + 1)),
        f"""ranked AS (SELECT id, term, round(score + 1e-9, 6) AS score FROM s{rounds}
          UNION ALL SELECT id, min(term), 1.0::DOUBLE FROM words GROUP BY id HAVING count(DISTINCT term) = 1)""",
    )


KEYWORDS_SQL = """best_terms AS (SELECT id, string_agg(term, ' ' ORDER BY r) AS keywords FROM (
  SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(1 + n / df), 6) DESC, term) AS r
  FROM tf JOIN df USING (term), n) WHERE r <= 10 GROUP BY id)"""
SUMMARY_SQL = r"""sentences AS (SELECT id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM (
  SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
    content, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)),
    lambda s: trim(s)), lambda s: regexp_matches(s, '[\p{L}\p{N}]')) AS parts FROM docs)),
rated AS (SELECT id, pos, any_value(sentence) AS sentence, round(sum(ln(1 + n / df)) / count(*), 6) AS score
  FROM (SELECT id, pos, sentence, unnest(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')) AS term
        FROM sentences) JOIN df USING (term), n GROUP BY id, pos),
best_sentences AS (SELECT id, string_agg(sentence, ' | ' ORDER BY pos) AS summary FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS r FROM rated) WHERE r <= 5 GROUP BY id)"""

CHECKS = {
    "f1_tokens": fx.with_sql(_D)
    + f"""SELECT id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT id, {fx.TOKENS_SQL} AS t FROM docs)""",
    "f2_keywords": fx.with_sql(_D, _WORDS, _DF)
    + """SELECT id, string_agg(term, ' ' ORDER BY r) AS keywords FROM (
        SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(1 + n / df), 6) DESC, term) AS r
        FROM tf JOIN df USING (term), n) WHERE r <= 10 GROUP BY id""",
    "f3_rank_scores": _ranked(2) + "SELECT * FROM ranked",
    "f3_rank_all_rounds": _ranked(text_analysis.RANK_ROUNDS) + "SELECT * FROM ranked",
    "f3_rank_keywords": _ranked(2)
    + """SELECT id, string_agg(term, ' ' ORDER BY r) AS keywords FROM (
        SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS r FROM ranked)
        WHERE r <= 10 GROUP BY id""",
    "f4_summaries": fx.with_sql(_D, _WORDS, _DF, SUMMARY_SQL) + "SELECT * FROM best_sentences",
    "f5_named_entities": fx.with_sql(_D, GAZETTEER_SQL)
    + "SELECT id, "
    + ", ".join(
        f"coalesce(string_agg(surface, '/' ORDER BY surface) FILTER (type = '{k}'), '') AS {k}" for k in ("nr", "ns", "nt")
    )
    + " FROM mentions GROUP BY id",
}


def _plain_sql() -> str:
    from corpusloom.plans.queries_extraction import _clean

    body = _clean(f"regexp_extract(html, '{fx.BODY_RULE}', 1)")
    return f"SELECT url, replace({body}, '<br/>', ' ') AS text FROM pages"


CHECKS["f6_plain_content"] = _plain_sql()
CHECKS["f5_entities_by_shuffle"] = CHECKS["f5_named_entities"]
