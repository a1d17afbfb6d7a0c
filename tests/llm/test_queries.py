"""Every query of the subpackage runs over its whole table; those with SQL equal it."""

import __spark_entry__ as entry_module
import pytest
from compare import connect, duckdb_rows, spark_rows

from filecensus.llm.oracles import ORACLES
from filecensus.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_every_row_has_a_result(spark, name):
    table, key = {"op11": ("conversations", "conv_id"), "op12": ("embeddings", "vec_id")}.get(
        name.split("_")[0], ("documents", "doc_id"))
    found = [row[key] for row in QUERIES[name](spark, FOLDER).collect()]
    rows = [row[key] for row in spark.read.parquet(f"{FOLDER}/{table}.parquet").collect()]
    if name.startswith(("op11", "op12", "op13")):  # a row of the table is none, one or several of the result
        rows, found = set(rows), set(found)
    assert sorted(found) == sorted(rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    expected_columns, expected = duckdb_rows(connect(FOLDER), ORACLES[name])
    assert columns == expected_columns and rows == expected and rows
