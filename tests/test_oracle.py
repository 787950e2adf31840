"""Every registered query against DuckDB, value for value and type for type."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tests.conftest import MEDIUM, SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()
SPARK_TYPE = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "DATE": "date",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


@pytest.fixture(scope="module", params=[SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
def folder(request):
    return request.param


@pytest.fixture(scope="module")
def oracle(folder):
    return connect(folder)


def ordered(found):
    return sorted(found, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_query_has_an_oracle():
    assert set(spark_entry.revenue_queries()) == set(spark_entry.ORACLE_SQL)


@pytest.mark.parametrize("name", list(spark_entry.revenue_queries()))
def test_query_matches_oracle(spark, folder, oracle, name):
    df = spark_entry.revenue_queries()[name](spark, folder)
    expected = oracle.execute(spark_entry.ORACLE_SQL[name])
    types = {column: SPARK_TYPE[str(kind)] for column, kind, *_ in expected.description}
    assert types == dict(df.dtypes)
    columns = sorted(types)
    position = {column: i for i, column in enumerate(types)}
    wanted = [tuple(row[position[c]] for c in columns) for row in expected.fetchall()]
    found = [tuple(row[c] for c in columns) for row in df.collect()]
    assert ordered(found) == ordered(wanted)


def test_entry_has_a_stable_schema(spark):
    df = spark_entry.entry(spark)
    assert df.columns[0] == "route_code"
    assert 0 < df.count() <= 15
