"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies: the source's target over its size.
Documents stand in one order, short ones first within a source; the expected copies before a document
are its rank in the source times that rate. One random offset per source is added, and the document is
taken once for every integer that its interval passes. A source's taken words so stay within about one
document of each length from their target, and no document is taken more than the ceiling of the rate.

Ranks are found without bringing a source together: rows are range-partitioned by source and length,
each part counts its rows per source, and the few part counts are summed up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ROW, WORD, materialise, settle, take, with_row_numbers
from corpusloom.session import broadcast_if_small

#: Weights of the sources in ascending order of their names, repeated; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix per word of the input, and the most a source or document may be repeated.
SHARE = 1.5
REPEATS = 2.0
SEED = 17


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets_of(sizes: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """``sizes`` (source, docs, size) with ``target``: a row per source, as few as there are sources.

    Targets go up with the weights until a source is full at ``repeats`` times its size; the rest goes on.
    So there is one level at which every target is the smaller of its capacity and weight times level. The
    level is found where the sources, ordered by the level that fills them, have taken what is to be shared.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    capacity = F.col("size") * repeats
    full_at = weighted.withColumn("full_at", capacity / F.col("weight"))
    by_level = every.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("size").over(every) * share
    open_level = (total - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # From the first source on that this level doesn't fill, the level is right; further on it only falls.
    levels = full_at.withColumn("total", total).withColumn("open_level", open_level)
    level = F.max(F.when(F.col("open_level") <= F.col("full_at"), F.col("open_level"))).over(every)
    target = F.when(F.col("size") == 0, 0.0).otherwise(F.least(capacity, F.col("weight") * F.coalesce(level, F.lit(float("inf")))))
    return levels.withColumn("target", target).select("source", "docs", "size", "target")


def plan_mix(
    docs: DataFrame,
    doc_id: Column,
    source: Column,
    text: Column,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    repeats: float = REPEATS,
    seed: int = SEED,
    row: Column | None = None,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every row of ``docs``.

    ``size`` is the number of words, 0 for a null text; such rows are part of the order but take no words.
    A null source is a source of its own. Rows that repeat an id are documents of their own, and so are rows
    without an id; equal rows are taken in any order, with the same result. Reruns agree: order and offsets
    depend on the rows and ``seed`` only. With ``row``, a number that tells rows apart, the plan has it as ``ROW``
    and rows that are equal else stand in its order. Other columns are not looked at. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    own = [] if row is None else [ROW]
    numbered = [] if row is None else [row.alias(ROW)]
    sized = docs.select(doc_id.alias("doc_id"), source.alias("source"), words_in(text).alias("size"), *numbered)
    sized = sized.withColumn("tie", F.xxhash64(F.lit(seed), F.col("doc_id")))
    order = [F.col("source").asc_nulls_last(), "size", "tie", "doc_id", *own]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    placed = sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "mix-sizes")

    blocks = placed.groupBy("source", "part").agg(F.count("*").alias("docs"), F.sum("size").alias("size"))
    sizes = blocks.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("size").alias("size"))
    targets = targets_of(sizes, weights, share, repeats)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "source", "part", F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("before")
    )
    rates = targets.select(
        F.col("source").alias("of_source"),
        F.col("size").alias("source_size"),
        "target",
        F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate"),
    )
    blocks = blocks.join(rates, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    blocks = broadcast_if_small(
        materialise(blocks.withColumnsRenamed({"source": "block_source", "part": "block_part"}), "mix-blocks")
    )
    same = F.col("source").eqNullSafe(F.col("block_source")) & (F.col("part") == F.col("block_part"))
    ranked = placed.join(blocks, same)
    inside = Window.partitionBy("part", "source").orderBy("size", "tie", "doc_id", *own)
    rank = F.col("before") + F.row_number().over(inside)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 31)) / float(1 << 31)
    passed = ranked.withColumn("rank", rank).withColumn("offset", offset)
    copies = F.floor(F.col("offset") + F.col("rank") * F.col("rate")) - F.floor(
        F.col("offset") + (F.col("rank") - 1) * F.col("rate")
    )
    return passed.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *own
    )


def mix_rows(docs: DataFrame, stored: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, in no given order.

    Every row has its own number of copies, whether its id is repeated or null. ``stored`` is that of
    ``with_row_numbers``.
    """
    rows = with_row_numbers(docs, stored)

    def taken_rows() -> DataFrame:
        plan = plan_mix(rows, F.col("doc_id"), F.col("source"), F.col("text"), row=F.col(ROW), **options)
        return plan.filter("copies > 0").select(ROW, F.col("copies").cast("int").alias("copies"))

    return take(rows, settle(docs.sparkSession, "mix-taken", taken_rows)).select(*docs.columns)
