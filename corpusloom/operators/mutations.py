"""Changes to stored tables as new frames: nothing is edited in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import values


def last_written(docs: DataFrame, key: str = "id", version: str = "gatherTime") -> DataFrame:
    """The newest row per key. The rank limit is applied before the shuffle, so that a key with
    very many copies sends one row per task."""
    rest = [c for c in docs.columns if c not in (key, version)]
    tie = F.xxhash64(*(F.col(c) for c in rest if not docs.schema[c].dataType.typeName() == "map")).desc()
    newest = Window.partitionBy(key).orderBy(F.col(version).desc(), tie)
    return docs.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def upsert(store: DataFrame, new: DataFrame, key: str = "id", version: str = "gatherTime") -> DataFrame:
    """Store with ``new`` written over it. Stored rows are only filtered, never rewritten by key: the
    anti join moves nothing but ids, and nothing of the store if ``new`` is small."""
    winners = last_written(new, key, version)
    kept = store.join(winners.select(key), key, "left_anti")
    return kept.unionByName(winners.select(*store.columns))


def flag_duplicates(new: DataFrame, store: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Incoming rows with a generated key where it is blank, and whether the key was there before: in the
    store, or in an earlier row of the batch by ``version`` (without one, in any other row but the first)."""
    keyed = new.withColumn(key, F.coalesce(F.nullif(F.trim(F.col(key)), F.lit("")), F.expr("uuid()")))
    known = store.select(F.col(key), F.lit(True).alias("_known")).distinct()
    in_turn = Window.partitionBy(key).orderBy(*_order(new, key, version))
    return (
        keyed.withColumn("_turn", F.row_number().over(in_turn))
        .join(known, key, "left")
        .withColumn("is_duplicate", F.coalesce("_known", F.lit(False)) | (F.col("_turn") > 1))
        .drop("_known", "_turn")
    )


def _order(rows: DataFrame, key: str, version: str | None) -> list[Column]:
    """Ascending ``version``, then an order that depends on the row only."""
    plain = [c for c in rows.columns if c != key and rows.schema[c].dataType.typeName() != "map"]
    tie = F.xxhash64(*(F.col(c) for c in plain)) if plain else F.lit(0)
    return [F.col(version), tie] if version else [tie]


def merged_updates(updates: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """One update per key: for every column the last value that is not null, by ``version``."""
    turn = F.struct(*_order(updates, key, version))
    given = [c for c in updates.columns if c != key]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), turn)).alias(c) for c in given]
    return updates.groupBy(key).agg(*last) if last else updates.distinct()


def unknown_keys(store: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """The keys of updates that no stored row has, for a report: ``partial_update`` changes nothing for them."""
    return updates.select(key).distinct().join(store.select(key), key, "left_anti")


def partial_update(
    store: DataFrame, updates: DataFrame, key: str = "id", version: str | None = None
) -> DataFrame:
    """Overwrite the non-null columns of stored rows; rows without an update, and nulls, change nothing.

    Several updates of a key are merged by ``version`` first. Updates of keys that aren't stored change
    nothing; ``unknown_keys`` lists them.
    """
    given = [c for c in updates.columns if c != key]
    merged = merged_updates(updates, key, version)
    renamed = merged.select(key, *(F.col(c).alias(f"_new_{c}") for c in given))
    joined = store.join(renamed, key, "left")
    return joined.select(
        *(F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in store.columns)
    )


def affected(store: DataFrame, condition: Column) -> DataFrame:
    """``n_affected, found``: how many rows a delete or update by condition means, for its report."""
    return store.filter(F.coalesce(condition, F.lit(False))).agg(
        F.count("*").alias("n_affected"), (F.count("*") > 0).alias("found")
    )


def delete_keys(store: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def delete_where(store: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold; unknown counts as not holding."""
    return store.filter(~F.coalesce(condition, F.lit(False)))


def insert_or_update(
    store: DataFrame, rows: DataFrame, new_id: Column, key: str = "id", version: str | None = None
) -> DataFrame:
    """Rows with a blank key are inserted under ``new_id``; the others are partial updates by key, and
    inserted under their key if no stored row has it."""
    blank = values.is_blank(F.col(key))
    inserted = rows.filter(blank).withColumn(key, new_id)
    updates = merged_updates(rows.filter(~blank), key, version)
    absent = updates.join(store.select(key), key, "left_anti")
    updated = partial_update(store, updates, key)
    return updated.unionByName(inserted, allowMissingColumns=True).unionByName(absent, allowMissingColumns=True)
