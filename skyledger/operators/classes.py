"""Revenue by cabin class, over all routes whether or not their airports are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.filters import FilterSpec
from skyledger.functions.labels import cabin_label
from skyledger.functions.measures import as_double, ratio, total
from skyledger.sources.marts import Marts


def _by_class(marts: Marts, spec: FilterSpec) -> DataFrame:
    return (
        marts.revenue_by_route_class.filter(spec.class_matches())
        .groupBy("class")
        .agg(total("ticket_count"), total("revenue"))
    )


def _columns() -> list:
    return [
        "class",
        "ticket_count",
        as_double("revenue"),
        cabin_label(F.col("class")).alias("cabin_class"),
    ]


def class_revenue(marts: Marts, spec: FilterSpec) -> DataFrame:
    return _by_class(marts, spec).orderBy(F.desc("revenue"), "class").select(*_columns())


def class_revenue_share(marts: Marts, spec: FilterSpec) -> DataFrame:
    """Revenue by class and its part of the whole; null while the whole is 0.

    The window spans the frame, which has one row per class asked for.
    """
    whole = F.sum("revenue").over(W.partitionBy())
    return (
        _by_class(marts, spec)
        .withColumn("revenue_share", ratio(F.col("revenue"), whole))
        .orderBy(F.desc("revenue"), "class")
        .select(*_columns(), "revenue_share")
    )
