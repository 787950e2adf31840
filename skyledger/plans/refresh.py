"""Building the marts and writing them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.marts import builders_from_partials, mart_builders, ticket_partials
from skyledger.plans.materialise import scratch_folder
from skyledger.plans.together import Failed, once, together
from skyledger.sources.buckets import BUCKETED_MARTS, write_in_buckets
from skyledger.sources.marts import Marts, check_unique_routes, mart_path
from skyledger.sources.publications import PARTIALS, RUNS, publish_marts
from skyledger.sources.tables import RawTables

STATUS = "mart string, rows bigint, status string, error string"


def write_counted(spark: SparkSession, df: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write ``df`` as Parquet; the rows are counted on their way to the files."""
    counted = Observation()
    observed = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    if buckets:
        write_in_buckets(observed, path, buckets)
    else:
        observed.write.parquet(path)
    rows = counted.get.get("rows")
    # A plan that turns out empty while it runs may leave without its count.
    return spark.read.schema(df.schema).parquet(path).count() if rows is None else rows


def write_mart(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], path: str, buckets: int | None = None
) -> int:
    """Write a mart once and check it; returns its rows. Only routes are read again."""
    rows = write_counted(spark, build(), path, buckets if name in BUCKETED_MARTS else None)
    if name == "routes_with_airports":
        check_unique_routes(spark.read.parquet(path))
    return rows


def _short(error: Exception) -> str:
    """The kind of an error and its first line, without the trace below it."""
    lines = str(error).strip().splitlines()
    return f"{type(error).__name__}: {lines[0] if lines else ''}"


def write_marts(
    spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]], folder: str, buckets: int | None = None
) -> tuple[dict[str, str], list[tuple]]:
    """Write all marts at once to a new run; those that are good, and a status row for each."""
    run = f"{RUNS}/{uuid.uuid4().hex}"
    jobs = {
        name: partial(write_mart, spark, name, build, mart_path(f"{folder}/{run}", name), buckets)
        for name, build in builders.items()
    }
    status, done = [], {}
    for name, rows in together(spark, jobs).items():
        if isinstance(rows, Failed):
            status.append((name, None, "failed", _short(rows.cause)))
        else:
            status.append((name, rows, "written", None))
            done[name] = run
    return done, status


def write_partials(spark: SparkSession, partials: DataFrame, folder: str) -> str:
    """Write partial sums of tickets under ``folder``; returns their place in it."""
    place = f"{PARTIALS}/{uuid.uuid4().hex}"
    partials.write.parquet(f"{folder}/{place}")
    return place


def _derived(spark: SparkSession, source: RawTables, folder: str) -> dict[str, Callable[[], DataFrame]]:
    """Builders that read the tickets once, whichever mart asks first."""

    def partials() -> DataFrame:
        found = ticket_partials(source.tickets)
        return spark.read.schema(found.schema).parquet(f"{folder}/{write_partials(spark, found, folder)}")

    return builders_from_partials(source, once(partials))


def marts_of_one_reading(tables: RawTables) -> Marts:
    """The marts as plans over partial sums that are made now, by one reading of the tickets.

    For answers that need both revenue marts, of tickets that are costly to make.
    """
    found = ticket_partials(tables.tickets)
    spark = found.sparkSession
    path = scratch_folder(spark, "ticket-partials")
    found.write.parquet(path)  # not a checkpoint, which computes what it keeps twice
    return Marts(builders_from_partials(tables, lambda: spark.read.schema(found.schema).parquet(path)))


def refresh_marts(
    spark: SparkSession,
    source: RawTables | Mapping[str, Callable[[], DataFrame]],
    folder: str,
    buckets: int | None = None,
) -> DataFrame:
    """Build and write every mart under ``folder``; one status row per mart.

    The marts are written at the same time, each once, to a folder of this run. Those
    that were written and passed their checks are then published together, by one small
    file that ``read_marts`` follows; so a mart that fails in any step is reported and
    skipped, and its last published version stays. Of two refreshes at once the later
    publication counts, mart by mart. Earlier runs stay on disk, for readers that have
    begun, until ``clear_old_runs``.

    ``source`` is the raw tables, or a function per mart such as those of
    ``builders_in_database``. Tickets that are derived by joins are read once, to partial
    sums that both revenue marts are made of; plain ones twice, which is faster.
    """
    if not isinstance(source, RawTables):
        builders = source
    elif source.derived:
        builders = _derived(spark, source, folder)
    else:
        builders = mart_builders(source)
    done, status = write_marts(spark, builders, folder, buckets)
    if done:
        publish_marts(spark, folder, done, buckets)
    return spark.createDataFrame(status, STATUS)
