"""Table shapes: the three raw tables and the three marts built from them."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_MONEY = T.DecimalType(12, 2)
_DEGREES = T.DecimalType(9, 6)

TICKETS = _fields(
    ("route_code", T.StringType()),
    ("class", T.StringType()),
    ("total_amount", _MONEY),
    ("airport_tax", _MONEY),
    ("local_tax", _MONEY),
    ("departure", T.TimestampNTZType()),
)

ROUTES = _fields(
    ("route_code", T.StringType()),
    ("origin", T.StringType()),
    ("destination", T.StringType()),
    ("distance", T.DecimalType(8, 1)),
    ("flight_minutes", T.IntegerType()),
    ("parent_route", T.StringType()),
    ("leg_number", T.IntegerType()),
)

AIRPORTS = _fields(
    ("iata_code", T.StringType()),
    ("airport", T.StringType()),
    ("city", T.StringType()),
    ("country", T.StringType()),
    ("continent", T.StringType()),
    ("latitude", _DEGREES),
    ("longitude", _DEGREES),
    ("airport_tax", T.DecimalType(6, 2)),
)

RAW_TABLES = {"tickets": TICKETS, "routes": ROUTES, "airports": AIRPORTS}

# Attributes of an airport that a route carries for each of its two endpoints:
# source column -> suffix after "origin_" / "dest_".
ENDPOINT_ATTRIBUTES = {
    "airport": "airport",
    "city": "city",
    "country": "country",
    "continent": "continent",
    "latitude": "lat",
    "longitude": "lon",
    "airport_tax": "tax",
}

MART_COLUMNS = {
    "routes_with_airports": [
        "route_code",
        "origin",
        "destination",
        "parent_route",
        "leg_number",
        "distance",
        "flight_minutes",
        *[f"origin_{suffix}" for suffix in ENDPOINT_ATTRIBUTES.values()],
        *[f"dest_{suffix}" for suffix in ENDPOINT_ATTRIBUTES.values()],
    ],
    "revenue_by_route_class": [
        "route_code",
        "class",
        "ticket_count",
        "revenue",
        "avg_ticket_value",
        "total_airport_tax",
        "total_local_tax",
    ],
    "monthly_revenue": ["year", "month", "class", "ticket_count", "revenue"],
}
