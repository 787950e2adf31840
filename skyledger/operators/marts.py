"""From raw rows to the three marts.

Where tickets are costly to make or come file by file, ``ticket_partials`` reads them once
to the common grain of both revenue marts, from which these follow exactly.

The two revenue marts are partial-then-final hash aggregations: each task reduces
its rows to at most one per group before the shuffle, so neither the size of the
fact nor a route holding a large part of it shows up in the network or in a task.
Sums keep SQL's null for a group without a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.measures import exact_sum, ratio
from skyledger.schemas import ENDPOINT_ATTRIBUTES, MART_COLUMNS
from skyledger.sources.marts import Marts
from skyledger.sources.tables import RawTables


GRAIN = ["route_code", "class", "year", "month"]


def _measures(tickets: DataFrame) -> dict[str, Column]:
    """What is summed over tickets; sums and counts of parts add up to those of the whole."""
    return {
        "ticket_count": F.count(F.lit(1)),
        "priced_count": F.count("total_amount"),
        "revenue": exact_sum(tickets, "total_amount"),
        "total_airport_tax": exact_sum(tickets, "airport_tax"),
        "total_local_tax": exact_sum(tickets, "local_tax"),
    }


MEASURES = ["ticket_count", "priced_count", "revenue", "total_airport_tax", "total_local_tax"]


def _named(measures: dict[str, Column], names: list[str]) -> list[Column]:
    return [measures[name].alias(name) for name in names]


def _month_of(departure: str) -> list[Column]:
    return [F.year(departure).alias("year"), F.month(departure).alias("month")]


def ticket_partials(tickets: DataFrame) -> DataFrame:
    """Sums by route, class, year and month: the common grain of both revenue marts."""
    groups = tickets.groupBy("route_code", "class", *_month_of("departure"))
    return groups.agg(*_named(_measures(tickets), MEASURES))


def _added(partials: DataFrame, names: list[str]) -> dict[str, Column]:
    """Sums of partial sums, in their own types: a sum of all nulls stays null."""
    return {name: F.sum(name).cast(partials.schema[name].dataType) for name in names}


def merged_partials(partials: DataFrame) -> DataFrame:
    """Partial sums of several sets of tickets as those of all of them."""
    return partials.groupBy(*GRAIN).agg(*_named(_added(partials, MEASURES), MEASURES))


def _route_class_mart(groups: DataFrame) -> DataFrame:
    average = ratio(F.col("revenue"), F.col("priced_count"))
    return groups.withColumn("avg_ticket_value", average).select(*MART_COLUMNS["revenue_by_route_class"])


def _monthly_mart(groups: DataFrame) -> DataFrame:
    return groups.select(*MART_COLUMNS["monthly_revenue"]).orderBy("year", "month", "class")


def revenue_by_route_class(tickets: DataFrame) -> DataFrame:
    groups = tickets.groupBy("route_code", "class")
    return _route_class_mart(groups.agg(*_named(_measures(tickets), MEASURES)))


def monthly_revenue(tickets: DataFrame) -> DataFrame:
    groups = tickets.groupBy(*_month_of("departure"), "class")
    return _monthly_mart(groups.agg(*_named(_measures(tickets), ["ticket_count", "revenue"])))


def route_class_of_partials(partials: DataFrame) -> DataFrame:
    """``revenue_by_route_class`` of the tickets behind ``partials``."""
    groups = partials.groupBy("route_code", "class")
    return _route_class_mart(groups.agg(*_named(_added(partials, MEASURES), MEASURES)))


def monthly_of_partials(partials: DataFrame) -> DataFrame:
    """``monthly_revenue`` of the tickets behind ``partials``."""
    names = ["ticket_count", "revenue"]
    return _monthly_mart(partials.groupBy("year", "month", "class").agg(*_named(_added(partials, names), names)))


def routes_with_airports(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Routes whose two airports are both known, with the attributes of each.

    No broadcast hint: Spark broadcasts the airports while they are small, by
    their file size or at run time by their shuffled size, and merges or splits
    a skewed partition beyond that.
    """

    def endpoint(prefix: str, code: str) -> DataFrame:
        return airports.selectExpr(
            f"iata_code AS {code}",
            *[f"{name} AS {prefix}_{suffix}" for name, suffix in ENDPOINT_ATTRIBUTES.items()],
        )

    return (
        routes.join(endpoint("origin", "origin"), "origin")
        .join(endpoint("dest", "destination"), "destination")
        .select(*MART_COLUMNS["routes_with_airports"])
    )


def mart_builders(tables: RawTables) -> dict[str, Callable[[], DataFrame]]:
    """Mart name -> function that plans it, in the order of a refresh."""
    return {
        "routes_with_airports": lambda: routes_with_airports(tables.routes, tables.airports),
        "revenue_by_route_class": lambda: revenue_by_route_class(tables.tickets),
        "monthly_revenue": lambda: monthly_revenue(tables.tickets),
    }


def builders_from_partials(
    tables: RawTables, partials: Callable[[], DataFrame]
) -> dict[str, Callable[[], DataFrame]]:
    """``mart_builders`` with both revenue marts from partial sums of the tickets."""
    return {
        "routes_with_airports": lambda: routes_with_airports(tables.routes, tables.airports),
        "revenue_by_route_class": lambda: route_class_of_partials(partials()),
        "monthly_revenue": lambda: monthly_of_partials(partials()),
    }


def build_marts(tables: RawTables) -> Marts:
    return Marts(mart_builders(tables))
