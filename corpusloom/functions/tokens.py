"""Tokens, term counts and sentences of one text, without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.values import let

_CJK = r"一-鿿㐀-䶿぀-ヿ가-힯"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokens(text: Column) -> Column:
    """Words; runs of CJK characters become overlapping pairs (a lone character stays)."""
    lowered = F.lower(text)
    pieces = F.regexp_extract_all(lowered, F.lit(rf"([{_CJK}]+|[\p{{L}}\p{{N}}&&[^{_CJK}]]+)"), F.lit(1))

    def split(piece: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.length(piece) - 1), lambda i: F.substring(piece, i, F.lit(2))
        )
        return F.when(piece.rlike(f"^[{_CJK}]{{2}}"), pairs).otherwise(F.array(piece))

    with_pairs = F.flatten(F.transform(pieces, split))
    return F.when(lowered.rlike(f"[{_CJK}]"), with_pairs).otherwise(words(text))


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of tokens.

    Sorting brings equal tokens together; the distance between the first positions of two
    neighbouring groups is the count. No shuffle, and n log n in the length of the text.
    """

    def starts(ordered: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )

    def counted(ordered: Column, first: Column) -> Column:
        return F.transform(
            first,
            lambda at, k: F.struct(
                F.get(ordered, at).alias("term"),
                (F.coalesce(F.get(first, k + F.lit(1)), F.size(ordered)) - at).cast("long").alias("tf"),
            ),
        )

    empty = F.expr("cast(array() as array<struct<term:string,tf:bigint>>)")
    return let(
        F.sort_array(terms),
        lambda ordered: F.when(
            F.size(ordered) > 0, let(starts(ordered), lambda first: counted(ordered, first))
        ).otherwise(empty),
    )


def grams(terms: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by a space. ``terms`` should be bound with ``let``."""
    joined = terms
    for skip in range(1, n):
        shifted = F.slice(terms, F.lit(skip + 1), F.size(terms))
        joined = F.zip_with(joined, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(joined)


def sentences(text: Column) -> Column:
    """Non-blank sentences in order; cut after ``. ! ?`` plus white space, CJK stops and line ends."""
    cut = F.split(text, r"(?<=[.!?])\s+|(?<=[。！？；])|\n+")
    trimmed = F.transform(cut, lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: s.rlike(r"[\p{L}\p{N}]"))
