"""Headline totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.filters import FilterSpec
from skyledger.functions.measures import ratio, total
from skyledger.operators.rollup import selected_routes
from skyledger.sources.marts import Marts


def kpi_totals(marts: Marts, spec: FilterSpec, rollup: DataFrame | None = None) -> DataFrame:
    """Always one row; zeros when the filters leave nothing."""
    return (
        selected_routes(marts, spec, rollup)
        .agg(
            total("revenue"),
            total("ticket_count"),
            F.countDistinct("route_code").alias("active_routes"),
        )
        .select(
            F.col("revenue").cast("double").alias("total_revenue"),
            F.col("ticket_count").alias("total_tickets"),
            F.coalesce(ratio(F.col("revenue"), F.col("ticket_count")), F.lit(0.0)).alias(
                "avg_ticket"
            ),
            "active_routes",
        )
    )
