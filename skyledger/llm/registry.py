"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from skyledger.llm import oracle, queries

QUERIES = {name: query for name, query in vars(queries).items() if name.startswith("op")}
ORACLE_SQL = dict(oracle.ORACLE_SQL)
