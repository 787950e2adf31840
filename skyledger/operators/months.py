"""Revenue over time. Class and year filters apply; the continent filter does not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.filters import FilterSpec
from skyledger.functions.labels import cabin_label
from skyledger.functions.measures import as_double, month_start, total
from skyledger.sources.marts import Marts


def _selected_months(marts: Marts, spec: FilterSpec) -> DataFrame:
    return marts.monthly_revenue.filter(spec.class_matches() & spec.year_matches())


def _date():
    return month_start(F.col("year"), F.col("month")).alias("date")


def monthly_trend(marts: Marts, spec: FilterSpec) -> DataFrame:
    return (
        _selected_months(marts, spec)
        .groupBy("year", "month")
        .agg(total("revenue"), total("ticket_count"))
        .orderBy("year", "month")
        .select("year", "month", as_double("revenue"), "ticket_count", _date())
    )


def monthly_by_class(marts: Marts, spec: FilterSpec) -> DataFrame:
    """Months split by class, straight from the mart: an unknown revenue stays null."""
    return (
        _selected_months(marts, spec)
        .orderBy("year", "month", "class")
        .select(
            "year",
            "month",
            "class",
            "ticket_count",
            as_double("revenue"),
            cabin_label(F.col("class")).alias("cabin_class"),
            _date(),
        )
    )
