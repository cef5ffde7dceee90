"""Regex rules held in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_group(rule: Column) -> Column:
    """Wrap a rule without a capturing group in one, so that group 1 always exists."""
    bare = F.regexp_replace(F.regexp_replace(rule, r"\\.", ""), r"\[[^\]]*\]", "")
    groups = F.regexp_count(bare, F.lit(r"\((?!\?)|\(\?<[A-Za-z]"))
    return F.when(groups == 0, F.concat(F.lit("("), rule, F.lit(")"))).otherwise(rule)


def first_match(text: Column, rule: Column) -> Column:
    """Group 1 of the first match, or null. ``rule`` must have a group (see ``with_group``)."""
    found = F.call_function("regexp_extract", text, rule, F.lit(1))
    return F.when(found != "", found)


def all_matches(text: Column, rule: Column) -> Column:
    return F.regexp_extract_all(text, rule, F.lit(1))
