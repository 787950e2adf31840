"""Readers for the raw tables and the marts."""

from skyledger.sources.jdbc import JdbcSource, ReadSplit
from skyledger.sources.marts import Marts, MartsMissingError, read_marts
from skyledger.sources.order_tables import tables_from_orders
from skyledger.sources.publications import OvertakenError, clear_old_runs
from skyledger.sources.tables import (
    RawTables,
    conform,
    load_checked_tables,
    load_tables,
    normalise_columns,
    reject_counts,
)

__all__ = [
    "JdbcSource",
    "Marts",
    "MartsMissingError",
    "OvertakenError",
    "RawTables",
    "ReadSplit",
    "clear_old_runs",
    "conform",
    "load_checked_tables",
    "load_tables",
    "normalise_columns",
    "read_marts",
    "reject_counts",
    "tables_from_orders",
]
