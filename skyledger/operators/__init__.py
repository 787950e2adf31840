"""The questions, each a function from marts and filters to one DataFrame."""

from skyledger.operators.catalog import list_continents, list_years, source_stats
from skyledger.operators.classes import class_revenue, class_revenue_share
from skyledger.operators.geography import airport_revenue, continent_revenue, regional_revenue
from skyledger.operators.marts import (
    build_marts,
    mart_builders,
    monthly_revenue,
    revenue_by_route_class,
    routes_with_airports,
)
from skyledger.operators.matrix import region_matrix, region_matrix_wide
from skyledger.operators.months import monthly_by_class, monthly_trend
from skyledger.operators.rollup import route_rollup
from skyledger.operators.routes import route_efficiency, top_routes
from skyledger.operators.totals import kpi_totals

__all__ = [
    "airport_revenue",
    "build_marts",
    "class_revenue",
    "class_revenue_share",
    "continent_revenue",
    "kpi_totals",
    "list_continents",
    "list_years",
    "mart_builders",
    "monthly_by_class",
    "monthly_revenue",
    "monthly_trend",
    "region_matrix",
    "region_matrix_wide",
    "regional_revenue",
    "revenue_by_route_class",
    "route_efficiency",
    "route_rollup",
    "routes_with_airports",
    "source_stats",
    "top_routes",
]
