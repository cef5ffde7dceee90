"""Blank handling and small array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(value: Column) -> Column:
    """Null, empty, or white space only."""
    return value.isNull() | ~value.rlike(r"\S")


def blank_to_null(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    A column that a lambda refers to is an expression, which would otherwise run again for every
    element the lambda is applied to.
    """
    return F.get(F.transform(F.array(value), body), 0)


def last_by_name(entries: Column) -> Column:
    """Drop entries of an array of structs whose ``name`` comes again later in the array."""

    def kept(items: Column) -> Column:
        return F.filter(
            items,
            lambda e, i: ~F.exists(
                F.slice(items, i + F.lit(2), F.size(items)), lambda later: later["name"] == e["name"]
            ),
        )

    return let(entries, kept)


def salt_of(key: Column, salts: int) -> Column:
    """A number in ``[0, salts)`` that depends only on ``key``, so that retries agree."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
