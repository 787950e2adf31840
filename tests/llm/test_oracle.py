"""The queries that have SQL against DuckDB, value for value and type for type."""

from __future__ import annotations

import pytest

from skyledger.llm import registry
from tests.conftest import MEDIUM, SMALL
from tests.test_oracle import SPARK_TYPE, connect, ordered


@pytest.mark.parametrize("folder", [SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_matches_oracle(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    expected = connect(folder).execute(registry.ORACLE_SQL[name])
    kinds = SPARK_TYPE | {"BOOLEAN": "boolean"}
    assert {column: kinds[str(kind)] for column, kind, *_ in expected.description} == dict(df.dtypes)
    names = [column for column, *_ in expected.description]
    assert ordered([tuple(r[c] for c in names) for r in df.collect()]) == ordered(expected.fetchall())


def test_registry_has_every_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 14))
