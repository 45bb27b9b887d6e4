"""Every registered query against DuckDB on the smallest data folder."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from prosa.checks import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, name, QUERIES, ORACLE, DATA) is None


def test_all_are_checked():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
