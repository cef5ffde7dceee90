"""Documents to token ids: the training-data pipeline, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all of ``docs``, the rows of Parquet files as they were
read, and returns what is left of it, with the columns of ``documents``; the last returns the digests of what it
wrote. ``run`` writes the result of every stage as Parquet and hands it, read again, to the next.

Rows are told apart by their place in the files, so rows that share an id, or have none, are decided one by
one, and repeated rows are documents of their own. A null or empty text has no language and goes in the first
stage; later stages keep one that they are given. Texts of any length are taken whole. Ties go to the smaller id.
Empty tables give empty tables. Further columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, huffman_ids, jaccard_join, language_id, mixing
from corpusloom.llm.common import materialise, prepare, table
from corpusloom.llm.queries import public_tokenizer
from corpusloom.session import new_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled ones teach; others go.

    Texts without letters are rejected, and those that the model can't tell from other languages: the best
    score is below 0.3.
    """
    prepare(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of exact and near copies: the one with the smallest id."""
    prepare(spark)
    return jaccard_join.keep_one_of_each_group(docs, stored=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaky(docs, table(spark, sf_dir, "benchmark"), stored=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mix_rows(docs, stored=True)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the files of token ids hold, read back: a row per document of the mix."""
    prepare(spark)
    path = new_path(spark, "pipeline-ids")
    huffman_ids.write_ids(docs, path, public_tokenizer())
    return huffman_ids.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", keep_one_copy),
    ("decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("huffman_ids", write_token_ids),
]

#: SQL can express neither the language model nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
