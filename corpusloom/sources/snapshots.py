"""A table in a shared folder that grows by deltas: a log-structured store with merge on read.

The rows of a table lie in *base* files, in buckets by the hash of their key, and in *deltas*. A delta is
what one change adds: the rows it writes, and a *mark* for each key that it deletes or writes over. A write
costs what the change weighs, whatever the size of the table. A read merges: a row of the base or of a delta
counts unless a later delta has a mark for its key. ``compact`` folds the deltas into the buckets they
touch; other buckets keep their files. The number of buckets follows from measured bytes, and a compaction that
finds it outgrown deals the table anew.

What belongs to a snapshot is said by a numbered manifest. Nothing is edited in place, so a job never
overwrites what it reads, and a snapshot counts only once its manifest has been renamed into place.
``expire`` drops files that no kept snapshot needs. One writer at a time is assumed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import broadcast_if_small, drop_path, new_path

#: Bytes that a bucket of the base is planned for, and the factor it may outgrow that by before the table is dealt anew.
BUCKET_BYTES = 256 * 1024 * 1024
OUTGROWN = 4
#: A store is due for compaction with so many deltas, or with deltas of this share of its base.
DUE_DELTAS = 16
DUE_SHARE = 0.5

_BUCKET = "_bucket"
_SEEN = "_delta"


class _Files:
    """The folder of a table, by way of the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = root
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(status.getPath().getName() for status in self.fs.listStatus(self.path(folder)))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.fs.exists(self.path(name)) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under another name first: the file is there whole or not at all."""
        stream = self.fs.create(self.path(f"{name}.tmp"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self.path(f"{name}.tmp"), self.path(name)):
            raise OSError(f"cannot rename {self.root}/{name}.tmp")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _numbers(files: _Files) -> list[int]:
    return [int(n[:8]) for n in files.names("manifests") if n.endswith(".json")]


def _manifest(files: _Files, number: int | None = None) -> dict:
    numbers = _numbers(files)
    if not numbers or (number is not None and number not in numbers):
        raise LookupError(f"no such snapshot under {files.root}")
    return json.loads(files.read(f"manifests/{numbers[-1] if number is None else number:08d}.json"))


def _next(files: _Files) -> str:
    numbers = _numbers(files)
    version = f"{numbers[-1] + 1 if numbers else 0:08d}"
    for folder in ("data", "marks", "staged"):
        files.delete(f"{folder}/{version}")  # left by an attempt that failed
    return version


def _commit(files: _Files, version: str, manifest: dict) -> int:
    files.write(f"manifests/{version}.json", json.dumps(manifest))
    return int(version)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _buckets_for(n_bytes: int) -> int:
    """The power of two that gives buckets of about ``BUCKET_BYTES``."""
    return 1 << max(0, -(-n_bytes // BUCKET_BYTES) - 1).bit_length()


def _write_base(df: DataFrame, files: _Files, version: str, key: str, buckets: int) -> dict[str, str]:
    """Rows as files by bucket; the version of every bucket that has any."""
    placed = df.withColumn(_BUCKET, bucket_of(F.col(key), buckets))
    # Adaptive execution splits a bucket that is far larger than others over several tasks and files.
    placed.hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{files.root}/data/{version}")
    return {n.split("=")[1]: version for n in files.names(f"data/{version}") if n.startswith(f"{_BUCKET}=")}


def write_snapshot(df: DataFrame, root: str, key: str = "id", buckets: int | None = None) -> int:
    """Write ``df`` as the next snapshot, all of it; the number of the snapshot.

    Without ``buckets``, the rows are written once as they come, and dealt into buckets by their measured size.
    """
    spark = df.sparkSession
    files = _Files(spark, root)
    key = _manifest(files)["key"] if _numbers(files) else key
    version = _next(files)
    staged = df
    if buckets is None:
        df.write.parquet(f"{root}/staged/{version}")
        buckets = _buckets_for(files.size(f"staged/{version}"))
        staged = spark.read.schema(df.schema).parquet(f"{root}/staged/{version}")
    base = _write_base(staged, files, version, key, buckets)
    manifest = {"key": key, "buckets": buckets, "versions": base, "deltas": [], "schema": df.schema.jsonValue()}
    number = _commit(files, version, manifest)
    files.delete(f"staged/{version}")
    return number


def _read_base(spark: SparkSession, root: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    chosen = sorted((int(b), v) for b, v in manifest["versions"].items() if only is None or int(b) in only)
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root}/data/{v}/{_BUCKET}={b}" for b, v in chosen))


def _marks(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """``key, _delta``: the last delta that has a mark for each key."""
    key = T.StructType.fromJson(manifest["schema"])[manifest["key"]]
    paths = [f"{root}/marks/{version}" for version in manifest["deltas"]]
    found = spark.read.schema(T.StructType([key, T.StructField(_SEEN, T.IntegerType())])).parquet(*paths)
    return found.groupBy(manifest["key"]).agg(F.max(_SEEN).alias(_SEEN))


def _read(spark: SparkSession, root: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
    """The rows that count, of all buckets or of a few."""
    base = _read_base(spark, root, manifest, only)
    if not manifest["deltas"]:
        return base
    key, schema = manifest["key"], T.StructType.fromJson(manifest["schema"])
    held = T.StructType([*schema.fields, T.StructField(_SEEN, T.IntegerType())])
    added = spark.read.schema(held).parquet(*(f"{root}/data/{version}" for version in manifest["deltas"]))
    marks = _marks(spark, root, manifest)
    if only is not None:
        within = bucket_of(F.col(key), manifest["buckets"]).isin(sorted(only))
        added, marks = added.filter(within), marks.filter(within)
    marks = broadcast_if_small(marks.withColumnsRenamed({key: "_key", _SEEN: "_marked"}))
    rows = base.withColumn(_SEEN, F.lit(-1)).unionByName(added)
    later = (rows[key] == F.col("_key")) & (F.col("_marked") > rows[_SEEN])
    return rows.join(marks, later, "left_anti").drop(_SEEN)


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest snapshot, or an earlier one by number."""
    return _read(spark, root, _manifest(_Files(spark, root), number))


def has_snapshot(spark: SparkSession, root: str) -> bool:
    return bool(_numbers(_Files(spark, root)))


def write_delta(
    spark: SparkSession, root: str, rows: DataFrame | None = None, deleted: DataFrame | None = None
) -> int | None:
    """Write ``rows`` over the stored ones with their keys and delete the ``deleted`` keys, without reading or
    writing anything else; the number of the snapshot, or None if there was nothing to write.

    ``rows`` has one row per key. A key in both is deleted and written anew. Null keys can't be written over:
    a row with one is added.
    """
    files = _Files(spark, root)
    manifest = _manifest(files)
    key, schema = manifest["key"], T.StructType.fromJson(manifest["schema"])
    version, turn = _next(files), F.lit(len(manifest["deltas"])).cast("int").alias(_SEEN)
    if rows is None:
        rows = spark.createDataFrame([], schema)
    rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields), turn).write.parquet(f"{root}/data/{version}")
    stored = spark.read.schema(schema).parquet(f"{root}/data/{version}")
    marks = [stored.select(key)] + ([deleted.select(F.col(key).cast(schema[key].dataType))] if deleted is not None else [])
    marks = reduce(DataFrame.union, marks).filter(F.col(key).isNotNull()).distinct().select(key, turn)
    marks.write.parquet(f"{root}/marks/{version}")
    fresh = manifest | {"deltas": [*manifest["deltas"], version]}
    empty = [spark.read.parquet(f"{root}/{folder}/{version}").isEmpty() for folder in ("marks", "data")]
    if all(empty):
        for folder in ("data", "marks"):
            files.delete(f"{folder}/{version}")
        return None
    return _commit(files, version, fresh)


def change(
    spark: SparkSession, root: str, step: Callable[[DataFrame], DataFrame], touched: DataFrame | None = None
) -> DataFrame:
    """Apply ``step`` to the newest snapshot, write the result as the next, and read that back.

    ``touched`` has the keys of all rows that ``step`` adds, changes or drops. Then ``step`` is given the stored rows of
    these keys only, and what it returns is written as a delta, with marks for all of the keys; if there are none,
    nothing is. Without it, the whole table is read and written.
    """
    if touched is None:
        write_snapshot(step(read_snapshot(spark, root)), root)
        return read_snapshot(spark, root)
    key = _manifest(_Files(spark, root))["key"]
    # Worked out once: the keys choose the rows and become the marks.
    staged = new_path(spark, "change")
    touched.select(key).distinct().write.parquet(f"{staged}/keys")
    keys = spark.read.schema(touched.select(key).schema).parquet(f"{staged}/keys")
    if not keys.isEmpty():
        changed = step(read_snapshot(spark, root).join(broadcast_if_small(keys), key, "left_semi"))
        changed.write.parquet(f"{staged}/rows")
        write_delta(spark, root, spark.read.schema(changed.schema).parquet(f"{staged}/rows"), keys)
    drop_path(spark, staged)
    return read_snapshot(spark, root)


def delta_sizes(spark: SparkSession, root: str) -> tuple[int, int, int]:
    """How many deltas there are, their bytes, and the bytes of the base."""
    files = _Files(spark, root)
    manifest = _manifest(files)
    own = sum(files.size(f"{folder}/{v}") for v in manifest["deltas"] for folder in ("data", "marks"))
    return len(manifest["deltas"]), own, _base_bytes(files, manifest)


def _base_bytes(files: _Files, manifest: dict) -> int:
    return sum(files.size(f"data/{v}/{_BUCKET}={b}") for b, v in manifest["versions"].items())


def compact(spark: SparkSession, root: str, only_if_due: bool = False) -> int | None:
    """Fold the deltas into the base; the number of the new snapshot, or None if there was nothing to do.

    Only buckets that a delta has rows or marks for are read and written, unless the table has outgrown its
    buckets; then all of it is dealt into as many as it needs now.
    """
    files = _Files(spark, root)
    manifest = _manifest(files)
    if not manifest["deltas"]:
        return None
    n_deltas, delta_bytes, base_bytes = delta_sizes(spark, root)
    if only_if_due and n_deltas < DUE_DELTAS and delta_bytes < DUE_SHARE * base_bytes:
        return None
    key, version = manifest["key"], _next(files)
    buckets = _buckets_for(base_bytes + delta_bytes)
    if buckets >= OUTGROWN * manifest["buckets"]:
        base = _write_base(_read(spark, root, manifest), files, version, key, buckets)
    else:
        buckets = manifest["buckets"]
        own = bucket_of(F.col(key), buckets).alias("b")
        marked = _marks(spark, root, manifest).select(own)
        # Null keys have no marks; their rows lie in the bucket of null.
        added = spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(
            *(f"{root}/data/{v}" for v in manifest["deltas"])
        )
        touched = {r.b for r in marked.union(added.select(own)).distinct().collect()}  # at most the number of buckets
        fresh = _write_base(_read(spark, root, manifest, touched), files, version, key, buckets)
        base = {b: v for b, v in manifest["versions"].items() if int(b) not in touched} | fresh
    return _commit(files, version, manifest | {"buckets": buckets, "versions": base, "deltas": []})


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Drop all but the ``keep`` newest snapshots, and versions that none of these needs; how many versions went."""
    if keep < 1:
        raise ValueError("one snapshot has to stay")
    files = _Files(spark, root)
    numbers = _numbers(files)
    kept = [_manifest(files, n) for n in numbers[-keep:]]
    needed = {v for m in kept for v in [*m["versions"].values(), *m["deltas"]]}
    for number in numbers[:-keep]:
        files.delete(f"manifests/{number:08d}.json")
    gone = [v for v in files.names("data") if v not in needed]
    for version in gone:
        files.delete(f"data/{version}")
        files.delete(f"marks/{version}")
    return len(gone)
