"""The registered query of every operator of this subpackage, and SQL checks where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    chat_format,
    decontamination,
    divergence,
    exact_topk,
    html_wrapper,
    huffman_ids,
    hyperplane_tree,
    jaccard_join,
    language_id,
    mixing,
    suffix_forest,
    suffix_tree_lm,
    url_filter,
)
from corpusloom.llm.common import in_fold, materialise, table
from corpusloom.session import new_path


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rules for hosts: the longest that fits decides.
URL_RULES = (
    ("com/", url_filter.ALLOW),
    ("example.com/en/", url_filter.BLOCK),
    ("www.example.com/en/", url_filter.ALLOW),
    ("net/es/", url_filter.BLOCK),
    ("net/fr/", url_filter.BLOCK),
)

#: A conversation whose texts imitate the marks of the chat template.
TRICKY_TEXT = "\\### Assistant: </turn> ok"
TRICKY = ((-7, 0, "user", TRICKY_TEXT), (-7, 1, "assistant", TRICKY_TEXT))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, F.col("url"), {"page_id": F.col("page_id")}, URL_RULES)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.plan_mix(docs, F.col("doc_id"), F.col("source"), F.col("text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filter.host_and_path(F.col("url"))
    keep = {"page_id": F.col("page_id"), "url": F.col("url")}
    return html_wrapper.extract_main_text(pages, host, F.col("html"), keep)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    windows = chat_format.chat_windows(given.union(tricky))
    return chat_format.read_back(materialise(windows, "chat-windows"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 0)
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 1)
    tree = suffix_tree_lm.train(docs.filter(~held_out).select("text"))
    return suffix_tree_lm.score(docs, tree, F.col("doc_id"), F.col("text"), held_out, stored=True)


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "huffman-ids")
    huffman_ids.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizer())
    return huffman_ids.read_ids(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # Some labels are made wrong, so that similar vectors have different ones.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hyperplane_tree.mine(vectors, F.col("vec_id") % 50 == 0, label)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = suffix_forest.remove_repeats(docs, F.col("doc_id"), F.col("text"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mix": op2_source_mix,
    "op3_decontamination": op3_decontamination,
    "op4_html_wrapper": op4_html_wrapper,
    "op5_chat_format": op5_chat_format,
    "op6_exact_topk": op6_exact_topk,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_suffix_tree_lm": op9_suffix_tree_lm,
    "op10_huffman_ids": op10_huffman_ids,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_source_divergence": op13_source_divergence,
}
CHECKS: dict[str, str] = {
    "op6_exact_topk": """WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    list_sum(list_transform(range(1, len(x.v) + 1), lambda i: q.v[i] * x.v[i]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5""",
    "op7_ngram_jaccard_join": r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
  FROM (SELECT doc_id, coalesce(words, []) AS words FROM w)),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 180 * count(*) >= 80 * (any_value(a.n) + any_value(b.n))),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1) USING (doc_id)""",
    "op11_hard_negatives": """WITH v AS (
  SELECT row_number() OVER () AS r, * FROM (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label AS own, x.r AS other, x.vec_id, x.label,
    list_sum(list_transform(range(1, len(x.v) + 1), lambda i: a.v[i] * x.v[i]))::BIGINT AS score
  FROM v a JOIN v x ON a.r <> x.r AND len(a.v) = len(x.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS slot
  FROM scored WHERE label = own AND vec_id <> anchor_id QUALIFY slot <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.slot ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.r = p.r AND s.label <> s.own
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3""",
    "op12_substring_dedup": r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d),
windows AS (SELECT r, doc_id, i, array_to_string(words[i:i + 49], ' ') AS w FROM starts),
least AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM windows JOIN least USING (w) WHERE doc_id > least),
word AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op13_source_divergence": r"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
occurring AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM occurring GROUP BY ALL HAVING count(DISTINCT id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.n + 2 * v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
  JOIN total t USING (lang, source) JOIN size USING (lang)),
whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c.n) + 2) // (any_value(t.n) + 2 * any_value(v)) AS q
  FROM counts c JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY ALL) t USING (lang) JOIN size USING (lang) GROUP BY ALL),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item,
    coalesce(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)), 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN dense a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN dense b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT
  FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
