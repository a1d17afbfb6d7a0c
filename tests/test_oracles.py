"""Every query gives what its SQL twin gives on the same tables."""

import __spark_entry__ as entry_module
import pytest
from compare import connect, duckdb_rows, spark_rows

from filecensus.oracles import ORACLES
from filecensus.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    expected_columns, expected = duckdb_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
