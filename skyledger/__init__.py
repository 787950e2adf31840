"""Revenue analytics over ticket sales on Apache Spark."""

from skyledger.filters import FilterSpec
from skyledger.operators import *  # noqa: F403
from skyledger.operators import __all__ as _questions
from skyledger.plans import (
    builders_in_database,
    export_csv,
    export_csv_file,
    export_report,
    refresh_marts,
    refresh_new_files,
    run_report,
)
from skyledger.session import build_session
from skyledger.sources import (
    JdbcSource,
    Marts,
    MartsMissingError,
    RawTables,
    ReadSplit,
    clear_old_runs,
    load_checked_tables,
    load_tables,
    read_marts,
    reject_counts,
    tables_from_orders,
)

__all__ = [
    "FilterSpec",
    "JdbcSource",
    "Marts",
    "MartsMissingError",
    "RawTables",
    "ReadSplit",
    "build_session",
    "builders_in_database",
    "clear_old_runs",
    "export_csv",
    "export_csv_file",
    "export_report",
    "load_checked_tables",
    "load_tables",
    "read_marts",
    "reject_counts",
    "refresh_marts",
    "refresh_new_files",
    "run_report",
    "tables_from_orders",
    *_questions,
]
