"""Every registered query gives the rows its SQL gives, on all data of the scale factor."""

from __future__ import annotations

import pytest
from parity import connect, duck_rows, spark_rows

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.01"
QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


# Queries of the training-data operators are not all for SQL; those that are have their tests beside the operators.
MARKETPLACE = [name for name in QUERIES if not name.startswith("op") and name != "pipeline"]


def test_every_query_has_its_sql():
    assert set(MARKETPLACE) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", MARKETPLACE)
def test_same_rows(spark, duck, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_names, expected = duck_rows(duck, ORACLES[name])
    assert names == expected_names
    assert len(rows) > 0
    assert rows == expected


def test_entry(spark):
    assert len(entry_point.entry(spark).collect()) == 2
