"""Refreshes that read only the ticket files they have not read before.

Beside the marts there are partial sums of the tickets at the common grain of both
revenue marts (route, class, year, month), one set for each refresh that found new
files, and a ledger of the files that are in them, with their sizes and times. A
refresh lists the files, reads the new ones into one more set, and makes the marts of
all sets: as many rows as there are groups, however many tickets there are. The sums
are exact, so the marts equal those of a full refresh.

A file that has changed or is gone cannot be taken out of the sums: then all files are
read anew, as on the first refresh. The publication that names the marts names the sets
and the ledger too, and follows just the one that the refresh began with; if another
refresh comes first, this one starts over from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.marts import (
    merged_partials,
    monthly_of_partials,
    route_class_of_partials,
    routes_with_airports,
    ticket_partials,
)
from skyledger.plans.refresh import STATUS, write_marts, write_partials
from skyledger.plans.together import once
from skyledger.schemas import RAW_TABLES
from skyledger.sources.publications import LEDGERS, OvertakenError, Publication, followed_by, latest, publish
from skyledger.sources.tables import conform

LEDGER = "file string, size bigint, modified timestamp"
#: Sets of partial sums that are merged into one when there are more.
MOST_SETS = 8
#: How often a refresh starts over because another one was first.
ATTEMPTS = 5


@dataclass(frozen=True)
class FileChanges:
    """Ticket files against the ledger of the last refresh."""

    added: list[str]
    stale: int  # changed or gone

    @property
    def all_anew(self) -> bool:
        return self.stale > 0


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size, modified) of every data file in ``folder``; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(
        F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def changes(now: DataFrame, ledger: DataFrame) -> FileChanges:
    """What is new, and how much is not as it was. Only names of new files are collected."""
    before = ledger.select(
        F.col("file").alias("_file"), F.col("size").alias("_size"), F.col("modified").alias("_modified")
    )
    both = now.join(before, F.col("file") == F.col("_file"), "full")
    same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    added = F.col("_file").isNull()
    stale = both.filter(~added & (F.col("file").isNull() | ~same)).count()
    names = both.filter(added).select("file").orderBy("file").toArrow().column("file").to_pylist()
    return FileChanges(names, stale)


def _partials_of(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    tickets = spark.read.option("basePath", folder).parquet(*files)
    return ticket_partials(conform(tickets, RAW_TABLES["tickets"]))


def _sets_after(
    spark: SparkSession, folder: str, tickets: str, base: Publication, files: list[str], anew: bool
) -> tuple[str, ...]:
    """The sets that hold all files: those of ``base``, and one of the new files."""
    sets = () if anew else base.partials
    if files:
        sets = (*sets, write_partials(spark, _partials_of(spark, tickets, files), folder))
    if len(sets) > MOST_SETS:
        merged = merged_partials(_read_sets(spark, folder, sets))
        sets = (write_partials(spark, merged, folder),)
    return sets


def _read_sets(spark: SparkSession, folder: str, sets: tuple[str, ...]) -> DataFrame:
    """Sets may differ in the widths of their decimals: a union takes the widest."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{place}") for place in sets])


def refresh_new_files(spark: SparkSession, tables: str, folder: str, buckets: int | None = None) -> DataFrame:
    """``refresh_marts`` of the tables in folder ``tables``, reading only new ticket files.

    ``tables`` has tickets.parquet, routes.parquet and airports.parquet, as for
    ``load_tables``; routes and airports are read in whole. One status row per mart;
    ``buckets`` as for ``refresh_marts``.
    """
    for _ in range(ATTEMPTS):
        try:
            return _refresh_after(spark, tables, folder, latest(spark, folder), buckets)
        except OvertakenError as error:
            overtaken = error
    raise overtaken


def _refresh_after(
    spark: SparkSession, tables: str, folder: str, base: Publication, buckets: int | None
) -> DataFrame:
    tickets = f"{tables}/tickets.parquet"
    place = f"{LEDGERS}/{uuid.uuid4().hex}"
    # Written first, so that what is read and what is recorded is one listing.
    list_files(spark, tickets).write.parquet(f"{folder}/{place}")
    now = spark.read.schema(LEDGER).parquet(f"{folder}/{place}")
    if base.ledger:
        found = changes(now, spark.read.schema(LEDGER).parquet(f"{folder}/{base.ledger}"))
    else:
        found = changes(now, spark.createDataFrame([], LEDGER))
    files = now.select("file").toArrow().column("file").to_pylist() if found.all_anew else found.added
    anew = found.all_anew or not base.ledger
    sets = once(lambda: _sets_after(spark, folder, tickets, base, files, anew))

    def partials() -> DataFrame:
        if not sets():
            return _partials_of(spark, tickets, [tickets])  # no file, or none with rows
        return _read_sets(spark, folder, sets())

    def dimension(name: str) -> DataFrame:
        return conform(spark.read.parquet(f"{tables}/{name}.parquet"), RAW_TABLES[name])

    def routes() -> DataFrame:
        return routes_with_airports(dimension("routes"), dimension("airports"))

    builders: dict[str, Callable[[], DataFrame]] = {
        "routes_with_airports": routes,
        "revenue_by_route_class": lambda: route_class_of_partials(partials()),
        "monthly_revenue": lambda: monthly_of_partials(partials()),
    }
    done, status = write_marts(spark, builders, folder, buckets)
    if not done:
        return spark.createDataFrame(status, STATUS)
    new = followed_by(base, done, buckets)
    try:
        new = replace(new, partials=sets(), ledger=place)
    except Exception:  # the tickets could not be read: their marts failed, and have said so
        new = replace(new, partials=base.partials, ledger=base.ledger)
    publish(spark, folder, base, new)
    return spark.createDataFrame(status, STATUS)
