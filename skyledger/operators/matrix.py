"""Regional revenue as a dense origin by destination matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.labels import UNKNOWN_REGION, compact_money


def region_matrix(regions: DataFrame) -> DataFrame:
    """A row per cell of the matrix over ``regional_revenue``; a missing pair is 0.

    Each origin becomes one row with its known cells. The axis of destinations is
    gathered from these few rows and put beside each, and exploding it makes just the
    cells of the matrix. The order of ``regions`` is of no use here: hand over
    ``regional_revenue(..., ordered=False)``.
    """
    cell = F.struct("dest_continent", "revenue")
    origins = regions.groupBy("origin_continent").agg(F.collect_set(cell).alias("cells"))
    known = F.transform("cells", lambda c: F.struct(c["dest_continent"].alias("name")))
    axis = F.array_distinct(F.flatten(F.collect_list(known).over(W.partitionBy())))
    of_cell = F.filter("cells", lambda c: c["dest_continent"].eqNullSafe(F.col("axis.name")))
    return (
        origins.withColumn("axis", axis)
        .select("origin_continent", "cells", F.explode("axis").alias("axis"))
        .select(
            "origin_continent",
            F.col("axis.name").alias("dest_continent"),
            F.coalesce(F.get(of_cell, F.lit(0))["revenue"], F.lit(0.0)).alias("revenue"),
        )
        .withColumn("label", compact_money(F.col("revenue")))
        .orderBy("origin_continent", "dest_continent")
    )


def region_matrix_wide(
    cells: DataFrame, destinations: Sequence[str] | None = None
) -> DataFrame:
    """The same matrix with one column per destination, "Unknown" for a null one.

    Without ``destinations`` Spark finds the columns by a job of its own over
    ``cells``; hand it a materialised frame then (``plans.materialise``).
    """
    named = cells.withColumn(
        "destination", F.coalesce("dest_continent", F.lit(UNKNOWN_REGION))
    )
    return (
        named.groupBy("origin_continent")
        .pivot("destination", list(destinations) if destinations is not None else None)
        .agg(F.sum("revenue"))
        .na.fill(0.0)
        .orderBy("origin_continent")
    )
