"""Ranked routes: by revenue, and by revenue per kilometre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.filters import FilterSpec
from skyledger.functions.labels import route_label
from skyledger.functions.measures import as_double, ratio
from skyledger.operators.rollup import selected_routes
from skyledger.sources.marts import Marts

_LABEL = ("route_code", "origin_city", "dest_city")


def top_routes(marts: Marts, spec: FilterSpec, rollup: DataFrame | None = None) -> DataFrame:
    """The ``top_n`` routes by revenue; equal revenue ranks by route code.

    The average is taken over the route's totals, not over class averages.
    """
    return (
        selected_routes(marts, spec, rollup)
        .orderBy(F.desc("revenue"), "route_code")
        .limit(spec.top_n)
        .select(
            "route_code",
            "ticket_count",
            as_double("revenue"),
            ratio(F.col("revenue"), F.col("ticket_count")).alias("avg_ticket_value"),
            "origin_city",
            "dest_city",
            "origin_continent",
            as_double("distance"),
            route_label(*map(F.col, _LABEL)).alias("route_label"),
        )
    )


def route_efficiency(
    marts: Marts, spec: FilterSpec, rollup: DataFrame | None = None
) -> DataFrame:
    """The ``top_n`` routes by revenue per kilometre, of those with a distance above 0."""
    return (
        selected_routes(marts, spec, rollup)
        .filter(F.col("distance") > 0)
        .withColumn("revenue_per_km", ratio(F.col("revenue"), F.col("distance")))
        .orderBy(F.desc("revenue_per_km"), "route_code")
        .limit(spec.top_n)
        .select(
            "route_code",
            "ticket_count",
            as_double("revenue"),
            "origin_city",
            "dest_city",
            "origin_continent",
            as_double("distance"),
            "revenue_per_km",
            route_label(*map(F.col, _LABEL)).alias("route_label"),
        )
    )
