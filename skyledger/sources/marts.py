"""The three marts as a bundle, and the reader for written ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, partial

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.schemas import MART_COLUMNS
from skyledger.sources.buckets import read_in_buckets
from skyledger.sources.publications import latest
from skyledger.sources.tables import normalise_columns


class DuplicateRouteError(ValueError):
    """A route code stands for more than one route."""


class MartsMissingError(FileNotFoundError):
    """A mart has not been written yet."""


class Marts:
    """The three marts, each planned when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]) -> None:
        self._builders = dict(builders)

    @cached_property
    def routes_with_airports(self) -> DataFrame:
        return self._builders["routes_with_airports"]()

    @cached_property
    def revenue_by_route_class(self) -> DataFrame:
        return self._builders["revenue_by_route_class"]()

    @cached_property
    def monthly_revenue(self) -> DataFrame:
        return self._builders["monthly_revenue"]()

    def _frames(self) -> list[DataFrame]:
        return [getattr(self, name) for name in MART_COLUMNS]

    def persist(self) -> Marts:
        """Keep the marts for reuse; blocks that do not fit in memory go to disk."""
        for frame in self._frames():
            frame.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> Marts:
        for frame in self._frames():
            frame.unpersist()
        return self


def mart_path(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet"


def check_unique_routes(routes: DataFrame) -> None:
    """Refuse routes that would count the revenue of a code more than once."""
    repeated = (
        routes.filter(F.col("route_code").isNotNull())
        .groupBy("route_code")
        .count()
        .filter(F.col("count") > 1)
        .orderBy("route_code")
        .select("route_code")
        .limit(5)
    )
    examples = [row.route_code for row in repeated.collect()]
    if examples:
        raise DuplicateRouteError(f"route_code is not unique, for example {examples}")


def read_marts(spark: SparkSession, folder: str, check_routes: bool = False) -> Marts:
    """Marts last published by ``refresh_marts``, or one Parquet file per mart.

    A missing mart is reported here, not when a question first needs it.
    ``check_routes`` refuses marts of another writer in which a route code stands for
    two routes, whose revenue would be counted twice.
    """
    last = latest(spark, folder)

    def read(name: str) -> DataFrame:
        path = mart_path(f"{folder}/{last.marts[name]}" if name in last.marts else folder, name)
        try:
            if name in last.buckets:
                found = read_in_buckets(spark, path, last.buckets[name])
            else:
                found = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise MartsMissingError(
                f"mart {name} not found at {path}; run refresh_marts first"
            ) from error
        return normalise_columns(found).select(*MART_COLUMNS[name])

    marts = Marts({name: partial(read, name) for name in MART_COLUMNS})
    marts._frames()
    if check_routes:
        check_unique_routes(marts.routes_with_airports)
    return marts
