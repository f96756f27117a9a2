"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_all_queries_have_sql():
    assert set(entry.REGISTRY) == set(entry.ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Product", "TotalSold", "TotalRevenue"]
    assert df.count() > 0


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, db, name):
    assert compare(spark, db, SMALL, name) == ""
