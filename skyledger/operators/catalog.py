"""What there is to choose from, and how much of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.measures import total
from skyledger.sources.marts import Marts


def list_continents(marts: Marts) -> DataFrame:
    return (
        marts.routes_with_airports.select("origin_continent")
        .dropna()
        .distinct()
        .orderBy("origin_continent")
    )


def list_years(marts: Marts) -> DataFrame:
    return marts.monthly_revenue.select("year").distinct().orderBy("year")


def source_stats(marts: Marts) -> DataFrame:
    """One row of counts. Airports are those used at either end of a route,
    countries those of origin airports; tickets are counted by the route mart.

    Each number is a small aggregation of its own, so no row is made more than once
    per distinct count. They meet by union and ``max``, which skips the nulls of the
    other parts.
    """
    routes = marts.routes_with_airports

    def different(values: DataFrame, name: str) -> DataFrame:
        column = values.columns[0]
        return values.distinct().agg(F.count(column).alias(name))

    ends = routes.select("origin").union(routes.select("destination"))
    parts = [
        different(routes.select("route_code"), "routes"),
        different(ends, "airports"),
        marts.revenue_by_route_class.agg(total("ticket_count").alias("tickets")),
        different(routes.select("origin_country"), "countries"),
        marts.monthly_revenue.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max")),
    ]
    columns = ["routes", "airports", "tickets", "countries", "year_min", "year_max"]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.agg(*[F.max(name).alias(name) for name in columns])
