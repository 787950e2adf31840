"""Whole jobs: refreshing the marts, answering a report, exporting it."""

from skyledger.plans.export import export_csv, export_csv_file, export_report
from skyledger.plans.incremental import refresh_new_files
from skyledger.plans.materialise import materialise, scratch_folder
from skyledger.plans.pushdown import builders_in_database
from skyledger.plans.refresh import marts_of_one_reading, refresh_marts
from skyledger.plans.report import run_report
from skyledger.sources.marts import DuplicateRouteError

__all__ = [
    "DuplicateRouteError",
    "builders_in_database",
    "export_csv",
    "export_csv_file",
    "export_report",
    "marts_of_one_reading",
    "materialise",
    "refresh_marts",
    "refresh_new_files",
    "run_report",
    "scratch_folder",
]
