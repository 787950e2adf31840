"""Command line, for spark-submit or ``python -m skyledger``.

    refresh --tables DIR --marts DIR [--new-files | --rejects DIR]
    refresh --jdbc-url URL --schema S --option user=U --option-env password=VAR --marts DIR
    clear --marts DIR --keep 2 --hours 24
    report --marts DIR --out DIR --cabin Economy --continent ASIA --year 1998 --top-n 10
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

import skyledger as sl
from skyledger.filters import TOP_N_DEFAULT


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skyledger")
    commands = parser.add_subparsers(dest="command", required=True)

    refresh = commands.add_parser("refresh", help="build the marts from the raw tables")
    refresh.add_argument("--marts", required=True, help="folder to write the marts to")
    source = refresh.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder with tickets, routes and airports as Parquet")
    source.add_argument("--jdbc-url", help="database that groups the tickets itself")
    refresh.add_argument("--schema", help="schema of the tables in the database")
    refresh.add_argument(
        "--option", action="append", default=[], metavar="KEY=VALUE", help="JDBC reader option"
    )
    refresh.add_argument(
        "--option-env",
        action="append",
        default=[],
        metavar="KEY=VARIABLE",
        help="JDBC reader option whose value is in an environment variable",
    )

    refresh.add_argument("--buckets", type=int, help="divide the marts by route code into so many")
    how = refresh.add_mutually_exclusive_group()
    how.add_argument(
        "--new-files", action="store_true", help="read only ticket files that no refresh has read yet"
    )
    how.add_argument("--rejects", help="folder to write rows to that do not fit, instead of failing")

    clear = commands.add_parser("clear", help="delete runs that are not published any more")
    clear.add_argument("--marts", required=True, help="folder with the marts")
    clear.add_argument("--keep", type=int, default=2, help="publications whose runs stay")
    clear.add_argument("--hours", type=float, default=24.0, help="what is younger stays")

    report = commands.add_parser("report", help="write the answers of one filter set as CSV")
    report.add_argument("--marts", required=True, help="folder with the marts")
    report.add_argument("--out", required=True, help="folder to write the files to")
    report.add_argument("--cabin", action="append", default=[], help="default: all")
    report.add_argument("--continent", action="append", default=[], help="default: all")
    report.add_argument("--year", default="All")
    report.add_argument("--top-n", type=int, default=TOP_N_DEFAULT)
    return parser


def _jdbc_source(args: argparse.Namespace) -> sl.JdbcSource:
    options = dict(pair.split("=", 1) for pair in args.option)
    for pair in args.option_env:
        key, variable = pair.split("=", 1)
        options[key] = os.environ[variable]
    return sl.JdbcSource(args.jdbc_url, args.schema, options)


def _source(spark: SparkSession, args: argparse.Namespace):
    if not args.tables:
        return sl.builders_in_database(spark, _jdbc_source(args))
    if not args.rejects:
        return sl.load_tables(spark, args.tables)
    tables, rejects = sl.load_checked_tables(spark, args.tables)
    rejects.write.parquet(args.rejects)
    sl.reject_counts(spark.read.schema(rejects.schema).parquet(args.rejects)).show(truncate=False)
    return tables


def _clear(spark: SparkSession, args: argparse.Namespace) -> int:
    for path in sl.clear_old_runs(spark, args.marts, args.keep, args.hours):
        print(path)
    return 0


def _refresh(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.new_files:
        status = sl.refresh_new_files(spark, args.tables, args.marts, args.buckets)
    else:
        status = sl.refresh_marts(spark, _source(spark, args), args.marts, args.buckets)
    status.show(truncate=False)
    return int(status.filter("status <> 'written'").count() > 0)


def _report(spark: SparkSession, args: argparse.Namespace) -> int:
    spec = sl.FilterSpec.from_selection(args.cabin, args.continent, args.year, args.top_n)
    with sl.run_report(sl.read_marts(spark, args.marts), spec) as answers:
        answers["source_stats"].show()
        answers["kpi_totals"].show()
        for answer, path in sl.export_report(answers, args.out).items():
            print(f"{answer}: {path}")
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command == "refresh" and not args.tables and (args.new_files or args.rejects):
        parser.error("--new-files and --rejects go with --tables")
    session = spark or sl.build_session()
    return {"refresh": _refresh, "clear": _clear, "report": _report}[args.command](session, args)


if __name__ == "__main__":
    raise SystemExit(main())
