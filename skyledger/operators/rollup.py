"""The frame behind every question about places: one row per route."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.filters import FilterSpec
from skyledger.functions.measures import total
from skyledger.sources.marts import Marts


# What the questions use of a route, beside its code.
ROUTE_ATTRIBUTES = [
    "distance",
    "origin",
    "origin_airport",
    "origin_city",
    "origin_continent",
    "origin_lat",
    "origin_lon",
    "dest_city",
    "dest_continent",
]


def route_rollup(marts: Marts, classes: Iterable[str]) -> DataFrame:
    """Tickets and revenue of each route over ``classes``, with the route's ends.

    The fact side is aggregated to one row per route before it meets the
    dimension, and both sides are then unique on the join key. A route code
    without known airports stays, with null attributes.
    """
    network = marts.routes_with_airports.select("route_code", *ROUTE_ATTRIBUTES)
    return (
        marts.revenue_by_route_class.filter(F.col("class").isin(list(classes)))
        .groupBy("route_code")
        .agg(total("ticket_count"), total("revenue"))
        .join(network, "route_code", "left")
    )


def selected_routes(
    marts: Marts, spec: FilterSpec, rollup: DataFrame | None = None
) -> DataFrame:
    """The rollup under the class and origin-continent filters.

    ``rollup`` is one built earlier for the same classes, to share it.
    """
    frame = route_rollup(marts, spec.classes) if rollup is None else rollup
    return frame.filter(spec.continent_matches())
