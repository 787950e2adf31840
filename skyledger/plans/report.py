"""One filter set, all answers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from skyledger import operators as ops
from skyledger.filters import FilterSpec
from skyledger.sources.marts import Marts


@contextmanager
def run_report(marts: Marts, spec: FilterSpec) -> Iterator[dict[str, DataFrame]]:
    """Every answer under one filter set, by name.

    ``marts`` are written or persisted ones, as most of them are read more than
    once. The route rollup and the regional revenue feed several answers and are
    kept until the block ends; use the answers inside it.
    """
    rollup = ops.route_rollup(marts, spec.classes).persist(StorageLevel.MEMORY_AND_DISK)
    regions = ops.regional_revenue(marts, spec, rollup).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield {
            "source_stats": ops.source_stats(marts),
            "kpi_totals": ops.kpi_totals(marts, spec, rollup),
            "top_routes": ops.top_routes(marts, spec, rollup),
            "class_revenue": ops.class_revenue(marts, spec),
            "class_revenue_share": ops.class_revenue_share(marts, spec),
            "continent_revenue": ops.continent_revenue(marts, spec, rollup),
            "regional_revenue": regions,
            "region_matrix": ops.region_matrix(regions),
            "monthly_trend": ops.monthly_trend(marts, spec),
            "monthly_by_class": ops.monthly_by_class(marts, spec),
            "route_efficiency": ops.route_efficiency(marts, spec, rollup),
            "airport_revenue": ops.airport_revenue(marts, spec, rollup),
        }
    finally:
        regions.unpersist()
        rollup.unpersist()
