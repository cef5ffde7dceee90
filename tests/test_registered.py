"""Every registered query against its SQL check, on a small copy of the tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registered
from check import compare

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query_matches_its_check(spark, name):
    assert compare(spark, SF_DIR, name) is None


def test_checks_belong_to_queries():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_flagship_has_rows(spark):
    assert registered.entry(spark).count() > 0
