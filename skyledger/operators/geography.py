"""Revenue by origin continent, by departure airport and by pair of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.filters import FilterSpec
from skyledger.functions.labels import region_label
from skyledger.functions.measures import as_double, mean, ratio, total
from skyledger.operators.rollup import route_rollup, selected_routes
from skyledger.sources.marts import Marts


def continent_revenue(
    marts: Marts, spec: FilterSpec, rollup: DataFrame | None = None
) -> DataFrame:
    """All known origin continents; only the class filter applies."""
    routes = route_rollup(marts, spec.classes) if rollup is None else rollup
    return (
        routes.filter(F.col("origin_continent").isNotNull())
        .groupBy("origin_continent")
        .agg(total("revenue"), total("ticket_count"))
        .orderBy(F.desc("revenue"), "origin_continent")
        .select("origin_continent", as_double("revenue"), "ticket_count")
    )


def airport_revenue(
    marts: Marts, spec: FilterSpec, rollup: DataFrame | None = None
) -> DataFrame:
    """Revenue of the departure airports that have coordinates.

    The origin code determines the attributes, so ``max`` picks the only value
    there is, whichever row comes first.
    """
    attributes = ["origin_airport", "origin_city", "origin_continent", "origin_lat", "origin_lon"]
    return (
        selected_routes(marts, spec, rollup)
        .groupBy("origin")
        .agg(
            *[F.max(name).alias(name) for name in attributes],
            total("ticket_count"),
            total("revenue"),
        )
        .dropna(subset=["origin_lat", "origin_lon"])
        .orderBy(F.desc("revenue"), "origin")
        .select(
            "origin",
            "origin_airport",
            "origin_city",
            "origin_continent",
            as_double("origin_lat"),
            as_double("origin_lon"),
            "ticket_count",
            as_double("revenue"),
        )
    )


def regional_revenue(
    marts: Marts, spec: FilterSpec, rollup: DataFrame | None = None, ordered: bool = True
) -> DataFrame:
    """Revenue from each origin continent to each destination continent.

    An unknown destination continent is a group of its own. The share is of all
    pairs shown, null while they add up to 0; its window spans the frame, which
    holds at most one row per pair of continents.
    """
    whole = F.sum("revenue").over(W.partitionBy())
    pairs = (
        selected_routes(marts, spec, rollup)
        .groupBy("origin_continent", "dest_continent")
        .agg(
            total("ticket_count"),
            total("revenue"),
            F.countDistinct("route_code").alias("route_count"),
            mean(F.col("distance")).alias("avg_distance"),
        )
        .withColumn("revenue_share", ratio(F.col("revenue"), whole))
    )
    if ordered:
        pairs = pairs.orderBy(F.desc("revenue"), "origin_continent", "dest_continent")
    return pairs.select(
        "origin_continent",
        "dest_continent",
        region_label(F.col("origin_continent"), F.col("dest_continent")).alias("region_pair"),
        "ticket_count",
        as_double("revenue"),
        "route_count",
        "avg_distance",
        ratio(F.col("revenue"), F.col("ticket_count")).alias("avg_ticket_value"),
        "revenue_share",
    )
