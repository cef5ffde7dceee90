"""Search by field over an inverted index: which documents have a value, a word or a value within bounds.

The index has two parts. *Entries* are postings by key, which is a field with an exact value or with a word of
its text; they lie in buckets by key, sorted, and carry the time by which results are ordered, so that a query
reads the folders of its keys and never a text. *Zones* are the values of fields with an order, each field a
folder, dealt by ranges into sorted files; bounds read the files whose zones they meet.

A query turns each clause into a set of ids. All sets are put together at once: a document's clauses become the bits of
a number, and must, should and not are conditions on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.operators import search, text_analysis
from corpusloom.operators.documents import page_of
from corpusloom.operators.search import Clause

ORDER = "gatherTime"
BUCKETS = 64
FILE_ROWS = 4_000_000
#: Clauses of a query: as many as a number has bits.
MOST_CLAUSES = 62

_EXACT, _WORD = "=", "~"


@dataclass(frozen=True)
class FieldIndex:
    """``entries(bucket, key, id, gatherTime)``; ``zones[field](value, id, gatherTime)``; ``buckets``."""

    entries: DataFrame
    zones: dict[str, DataFrame]
    buckets: int


def _key(field: str | Column, kind: str, value: Column) -> Column:
    return F.concat(F.lit(field) if isinstance(field, str) else field, F.lit(kind), value)


def _words(text: Column) -> Column:
    return F.array_distinct(tokens.tokens(text_analysis.plain_content(text)))


def _keys_of(docs: DataFrame, name: str) -> list[Column]:
    """The keys of one field of a row, as arrays."""
    kind, column = docs.schema[name].dataType.typeName(), F.col(name)
    if kind == "map":
        named = lambda k: F.concat(F.lit(f"{name}."), k)
        exact = F.transform(F.map_entries(column), lambda e: _key(named(e["key"]), _EXACT, e["value"]))
        words = F.transform(
            F.map_entries(column),
            lambda e: F.transform(_words(e["value"]), lambda w: _key(named(e["key"]), _WORD, w)),
        )
        return [exact, F.flatten(words)]
    found = [F.transform(column, lambda v: _key(name, _EXACT, v.cast("string")))] if kind == "array" else [
        F.array(_key(name, _EXACT, column.cast("string")))
    ]
    if name in search._TEXT_FIELDS:
        # A long text is looked for by its words only.
        text = F.array_join(column, " ") if kind == "array" else column
        found = ([] if name == "content" else found) + [F.transform(_words(text), lambda w: _key(name, _WORD, w))]
    return found


def write_field_index(
    docs: DataFrame,
    path: str,
    fields: Sequence[str],
    ranges: Sequence[str],
    buckets: int = BUCKETS,
    rows_per_file: int = FILE_ROWS,
) -> None:
    """Index ``fields`` of ``docs`` by value or word, and ``ranges`` by order. Null values are not indexed."""
    # Words of whole texts are many: they are told apart outside the row's expressions.
    texts = [name for name in dict.fromkeys(fields) if name == "content" and docs.schema[name].dataType.typeName() == "string"]
    found = [
        text_analysis.counted_terms(docs, F.col(name), "id", ORDER).select("id", ORDER, _key(name, _WORD, F.col("term")).alias("key"))
        for name in texts
    ]
    arrays = [F.coalesce(a, F.array().cast("array<string>")) for name in fields if name not in texts for a in _keys_of(docs, name)]
    if arrays:
        keys = F.explode(F.array_distinct(F.array_compact(F.concat(*arrays))))
        found.append(docs.select("id", ORDER, keys.alias("key")))
    entries = text_analysis.stored(reduce(DataFrame.unionByName, found), "field-entries")
    files = max(1, -(-entries.count() // rows_per_file))
    dealt = entries.withColumn("bucket", search._bucket(F.col("key"), buckets)).repartitionByRange(files, "bucket", "key", "id")
    dealt.sortWithinPartitions("bucket", "key", "id").write.partitionBy("bucket").parquet(f"{path}/entries")
    # One partition per range of values: files that don't meet a bound are known by their statistics.
    n_docs = max(1, -(-docs.count() // rows_per_file))
    for name in ranges:
        zone = docs.select(F.col(name).alias("value"), "id", F.col(ORDER)).filter(F.col("value").isNotNull())
        zone.repartitionByRange(n_docs, "value", "id").sortWithinPartitions("value").write.parquet(f"{path}/zones/{name}")
    every = docs.select(F.lit(buckets).alias("buckets"), F.array(*(F.lit(r) for r in ranges)).cast("array<string>").alias("ranges"))
    every.limit(1).write.parquet(f"{path}/shape")
    docs.select("id", ORDER).write.parquet(f"{path}/all")


def read_field_index(spark: SparkSession, path: str) -> FieldIndex:
    shape = spark.read.parquet(f"{path}/shape").first()
    ranges = list(shape["ranges"]) if shape else []
    zones = {name: spark.read.parquet(f"{path}/zones/{name}") for name in ranges}
    zones[""] = spark.read.parquet(f"{path}/all")
    return FieldIndex(spark.read.parquet(f"{path}/entries"), zones, shape["buckets"] if shape else BUCKETS)


def _clause_keys(clause: Clause, terms: dict[str, list[str]]) -> list[str] | None:
    """The keys that a clause looks up; None for bounds."""
    if clause.op == "is":
        value = str(clause.value).lower() if isinstance(clause.value, bool) else str(clause.value)
        return [f"{clause.field}{_EXACT}{value}"]
    if clause.op == "match":
        name = clause.field.partition(".")[0]
        if name not in search._TEXT_FIELDS and name != "dynamic_fields":
            raise ValueError(f"field {name!r} holds exact values; use op 'is'")
        return [f"{clause.field}{_WORD}{t}" for t in terms[str(clause.value)]]
    if clause.op in ("from", "to"):
        return None
    raise ValueError(f"unknown op {clause.op!r}")


def _bounded(index: FieldIndex, clause: Clause) -> DataFrame:
    if clause.field not in index.zones:
        raise ValueError(f"field {clause.field!r} has no zones")
    zone = index.zones[clause.field]
    bound = F.lit(clause.value).cast(zone.schema["value"].dataType)
    return zone.filter(F.col("value") >= bound if clause.op == "from" else F.col("value") <= bound)


def looked_up(index: FieldIndex, clauses: Sequence[Clause]) -> DataFrame:
    """``id, gatherTime, bits``: a row for every entry that a clause finds, with the bit of that clause."""
    if len(clauses) > MOST_CLAUSES:
        raise ValueError(f"a query has {MOST_CLAUSES} clauses at most")
    spark = index.entries.sparkSession
    terms = search._clause_terms(spark, clauses)
    masks: dict[str, int] = {}
    found: list[DataFrame] = []
    for number, clause in enumerate(clauses):
        keys = _clause_keys(clause, terms)
        for key in keys or []:
            masks[key] = masks.get(key, 0) | 1 << number
        if keys is None:
            found.append(_bounded(index, clause).select("id", ORDER, F.lit(1 << number).cast("long").alias("bits")))
    if masks:
        wanted = spark.createDataFrame(list(masks.items()), "key string, bits long")
        wanted = wanted.withColumn("bucket", search._bucket(F.col("key"), index.buckets))
        # As literals the buckets choose folders and the keys row groups.
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
        read = index.entries.filter(F.col("bucket").isin(*buckets) & F.col("key").isin(*masks))
        found.append(read.join(F.broadcast(wanted.select("key", "bits")), "key").select("id", ORDER, "bits"))
    return reduce(DataFrame.unionByName, found) if found else index.zones[""].select("id", ORDER, F.lit(0).cast("long").alias("bits")).limit(0)


def search_fields(index: FieldIndex, clauses: Sequence[Clause], size: int, page: int) -> DataFrame:
    """``id, gatherTime, n_should`` of the documents that meet the clauses, in the order of ``search.search_fields``:
    more ``should`` clauses met first, then newest, then by id."""
    masks = {need: sum(1 << i for i, c in enumerate(clauses) if c.need == need) for need in ("must", "should", "not")}
    found = looked_up(index, clauses)
    if not masks["must"] and not masks["should"]:
        # Nothing is asked for: all documents but those that a clause excludes.
        found = found.unionByName(index.zones[""].select("id", ORDER, F.lit(0).cast("long").alias("bits")))
    sets = found.groupBy("id").agg(F.bit_or("bits").alias("bits"), F.max(ORDER).alias(ORDER))

    def bits(need: str) -> Column:
        return F.col("bits").bitwiseAND(F.lit(masks[need]).cast("long"))

    kept = sets.filter((bits("must") == masks["must"]) & (bits("not") == 0))
    if masks["should"] and not masks["must"]:
        kept = kept.filter(bits("should") != 0)
    kept = kept.select("id", ORDER, F.bit_count(bits("should")).alias("n_should"))
    return page_of(kept, [F.col("n_should").desc(), F.col(ORDER).desc(), F.col("id")], size, page)
