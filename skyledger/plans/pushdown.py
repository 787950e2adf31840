"""Marts whose fact aggregations run inside the database that holds the fact."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.measures import ratio
from skyledger.operators.marts import routes_with_airports
from skyledger.schemas import MART_COLUMNS, RAW_TABLES
from skyledger.sources.jdbc import JdbcSource
from skyledger.sources.tables import conform


def _grouped(source: JdbcSource, keys: Mapping[str, str], measures: Mapping[str, str]) -> str:
    """SELECT over the tickets table: alias -> expression, grouped by the keys."""
    columns = ", ".join(f"{sql} AS {alias}" for alias, sql in {**keys, **measures}.items())
    return f"SELECT {columns} FROM {source.name_of('tickets')} GROUP BY {', '.join(keys.values())}"


def _route_class(spark: SparkSession, source: JdbcSource) -> DataFrame:
    """The average is left to Spark as sum over count: databases round an
    average of decimals each in their own way."""
    grouped = source.query(
        spark,
        _grouped(
            source,
            {"route_code": "route_code", "class": "class"},
            {
                "ticket_count": "COUNT(*)",
                "priced_count": "COUNT(total_amount)",
                "revenue": "SUM(total_amount)",
                "total_airport_tax": "SUM(airport_tax)",
                "total_local_tax": "SUM(local_tax)",
            },
        ),
    )
    average = ratio(F.col("revenue"), F.col("priced_count"))
    return grouped.withColumns(
        {"ticket_count": F.col("ticket_count").cast("bigint"), "avg_ticket_value": average}
    ).select(*MART_COLUMNS["revenue_by_route_class"])


def _monthly(spark: SparkSession, source: JdbcSource, year: str, month: str) -> DataFrame:
    grouped = source.query(
        spark,
        _grouped(
            source,
            {
                "year": year,
                "month": month,
                "class": "class",
            },
            {"ticket_count": "COUNT(*)", "revenue": "SUM(total_amount)"},
        ),
    )
    return grouped.withColumns(
        {
            "year": F.col("year").cast("int"),
            "month": F.col("month").cast("int"),
            "ticket_count": F.col("ticket_count").cast("bigint"),
        }
    ).orderBy("year", "month", "class")


def _network(spark: SparkSession, source: JdbcSource) -> DataFrame:
    return routes_with_airports(
        *[conform(source.table(spark, name), RAW_TABLES[name]) for name in ("routes", "airports")]
    )


def builders_in_database(
    spark: SparkSession,
    source: JdbcSource,
    year: str = "YEAR(departure)",
    month: str = "MONTH(departure)",
) -> dict[str, Callable[[], DataFrame]]:
    """Mart name -> function that plans it, with the fact grouped by the database.

    Only groups and the two dimensions cross the network. ``year`` and ``month`` are
    expressions in the database's dialect, such as EXTRACT(YEAR FROM departure).
    """
    return {
        "routes_with_airports": lambda: _network(spark, source),
        "revenue_by_route_class": lambda: _route_class(spark, source),
        "monthly_revenue": lambda: _monthly(spark, source, year, month),
    }
