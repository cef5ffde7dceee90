"""Pages deep in a list, and cursors that can be resumed, over a layout in the order of the list.

A listing holds rows by group and, within a group, in a total order. The layout is dealt by ranges of group and
order into parts of a given number of rows, so a group of any size is cut into many parts. Each row keeps its
*place*, a number that follows the order; each part of a group keeps how many rows it has, its first place and its
last key. A page reads the places that its number stands for, from the few parts that hold them, whether it is
the first or the ten-thousandth. A cursor is the key of a row as text: it reads on from the part that the key
falls into, also in another session, and after the listing was written again with more rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE_ROWS = 100_000

_PART, _PLACE = "__part", "__place"
#: Bits of a place within its part.
_PLACE_BITS = 33
#: Cursors keep times to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass(frozen=True)
class Listing:
    """``rows`` with part and place; ``parts(<by>, part, n, first, last)``; ``order`` as names, with whether descending."""

    rows: DataFrame
    parts: DataFrame
    order: list[tuple[str, bool]]
    by: str | None

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def of(self, df: DataFrame, group: object) -> DataFrame:
        return df if self.by is None else df.filter(F.col(self.by).eqNullSafe(F.lit(group)))


def _groups(by: str | None) -> list[str]:
    return [] if by is None else [by]


def write_listing(
    docs: DataFrame, path: str, order: Sequence[tuple[str, bool]], by: str | None = None, rows_per_file: int = FILE_ROWS
) -> None:
    """Lay out ``docs`` by ``by`` and then by ``order``, pairs of a name and whether it descends.

    The columns of ``order`` must tell rows of a group apart; of rows that they don't, a cursor shows those of one
    page only. Nulls come first in ascending and last in descending order; a null group is a group.
    """
    in_order = [F.col(name).desc() if down else F.col(name).asc() for name, down in order]
    in_order = [F.col(name) for name in _groups(by)] + in_order
    n_parts = max(1, -(-docs.count() // rows_per_file))
    placed = docs.repartitionByRange(n_parts, *in_order).sortWithinPartitions(*in_order)
    placed = placed.withColumn(_PLACE, F.monotonically_increasing_id())
    placed = placed.withColumn(_PART, F.shiftright(_PLACE, _PLACE_BITS).cast("int"))
    placed.sortWithinPartitions(_PART, _PLACE).write.partitionBy(_PART).parquet(f"{path}/rows")
    shape = json.dumps({"schema": placed.schema.jsonValue(), "order": [list(x) for x in order], "by": by})
    spark = docs.sparkSession
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    key = F.struct(*(F.col(name) for name, _ in order))
    parts = rows.groupBy(*_groups(by), _PART).agg(
        F.count("*").alias("n"), F.min(_PLACE).alias("first"), F.max_by(key, F.col(_PLACE)).alias("last")
    )
    parts.write.parquet(f"{path}/parts")
    spark.createDataFrame([(shape, parts.schema.json())], "shape string, parts string").coalesce(1).write.parquet(f"{path}/shape")


def read_listing(spark: SparkSession, path: str) -> Listing:
    stored = spark.read.parquet(f"{path}/shape").first()
    shape = json.loads(stored["shape"])
    rows = spark.read.schema(StructType.fromJson(shape["schema"])).parquet(f"{path}/rows")
    parts = spark.read.schema(StructType.fromJson(json.loads(stored["parts"]))).parquet(f"{path}/parts")
    return Listing(rows, parts, [(name, down) for name, down in shape["order"]], shape["by"])


def total(listing: Listing, group: object = None) -> int:
    """Rows of a group, or of all without groups, from the figures of the parts."""
    return listing.of(listing.parts, group).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page(listing: Listing, size: int, page: int, group: object = None) -> DataFrame:
    """Page ``page`` (from 1) of a group, in its order; no rows beyond the last."""
    if size < 0 or page < 1:
        raise ValueError("size must not be negative and pages count from 1")
    low, high = size * (page - 1), size * page
    before = F.sum("n").over(Window.partitionBy(*_groups(listing.by)).orderBy(_PART)) - F.col("n")
    parts = listing.of(listing.parts, group).withColumn("start", before)
    # As many as a page reaches into.
    held = parts.filter((F.col("start") < high) & (F.col("start") + F.col("n") > low)).select(_PART, "first", "start", "n").collect()
    ranges = [
        (F.col(_PART) == p[_PART])
        & F.col(_PLACE).between(p["first"] + max(0, low - p["start"]), p["first"] + min(p["n"], high - p["start"]) - 1)
        for p in held
    ]
    return _shown(listing, listing.rows.filter(reduce(Column.__or__, ranges, F.lit(False))))


def after(listing: Listing, size: int, cursor: str | None = None, group: object = None) -> DataFrame:
    """The next ``size`` rows of a group behind ``cursor``, or its first, with the ``cursor`` of each.

    The row of the cursor need not exist any more.
    """
    if size < 0:
        raise ValueError("size must not be negative")
    behind = F.lit(True) if cursor is None else _behind(listing, cursor, lambda name: F.col(name))
    open_parts = listing.of(listing.parts, group)
    if cursor is not None:
        open_parts = open_parts.filter(_behind(listing, cursor, lambda name: F.col("last")[name]))
    # The first part may hold few rows behind the cursor; the parts after it count in full.
    so_far = Window.partitionBy(*_groups(listing.by)).orderBy(_PART)
    earlier = F.sum("n").over(so_far) - F.col("n") - F.first("n").over(so_far)
    held = [p[_PART] for p in open_parts.withColumn("earlier", earlier).filter(F.col("earlier") < size).select(_PART).collect()]
    rows = listing.of(listing.rows.filter(F.col(_PART).isin(*held) if held else F.lit(False)), group).filter(behind)
    return _shown(listing, rows.withColumn("cursor", _as_text(listing)).orderBy(_PLACE).limit(size))


def scroll(listing: Listing, size: int, group: object = None, cursor: str | None = None) -> Iterator[list[Row]]:
    """Batches of ``size`` rows, one after another; the ``cursor`` of a batch's last row resumes behind it."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    while batch := after(listing, size, cursor, group).collect():
        yield batch
        cursor = batch[-1]["cursor"]


def cursor_of(listing: Listing, row: DataFrame) -> str | None:
    """The cursor behind the one row of a frame; None if it has none."""
    found = row.select(_as_text(listing).alias("cursor")).first()
    return found and found["cursor"]


def _as_text(listing: Listing) -> Column:
    return F.to_json(F.struct(*(F.col(name) for name, _ in listing.order)), _TIMES)


def _behind(listing: Listing, cursor: str, column) -> Column:
    """Whether a key comes after that of the cursor: by the first column in which they differ."""
    schema = StructType([listing.rows.schema[name] for name, _ in listing.order])
    key = F.from_json(F.lit(cursor), schema, _TIMES)
    found, equal = F.lit(False), F.lit(True)
    for name, down in listing.order:
        own, given = column(name), key[name]
        later = (own < given) | (own.isNull() & given.isNotNull()) if down else (own > given) | (own.isNotNull() & given.isNull())
        found = found | (equal & F.coalesce(later, F.lit(False)))
        equal = equal & own.eqNullSafe(given)
    return found


def _shown(listing: Listing, rows: DataFrame) -> DataFrame:
    return rows.orderBy(_PLACE).drop(_PART, _PLACE)
