"""Reading the star schema, or aggregates over it, from a database."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from skyledger.schemas import RAW_TABLES
from skyledger.sources.tables import RawTables, conform, normalise_columns


@dataclass(frozen=True)
class ReadSplit:
    """How the rows of a large table are shared out over parallel connections.

    The bounds only place the cuts; rows outside them, and nulls, are read too.
    """

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.partitions),
        }


@dataclass(frozen=True)
class JdbcSource:
    """A database holding the star schema.

    ``options`` are Spark's JDBC reader options (user, password, driver, ...) and
    come from the caller, so no credential lives in the library.
    """

    url: str
    schema: str | None = None
    options: Mapping[str, str] = field(default_factory=dict, repr=False)

    def name_of(self, table: str) -> str:
        return f"{self.schema}.{table}" if self.schema else table

    def _reader(self, spark: SparkSession):
        defaults = {"preferTimestampNTZ": "true", "fetchsize": "10000"}
        return (
            spark.read.format("jdbc")
            .option("url", self.url)
            .options(**{**defaults, **self.options})
        )

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        """Result of a statement that the database runs; for small results."""
        return normalise_columns(self._reader(spark).option("query", sql).load())

    def table(
        self, spark: SparkSession, table: str, split: ReadSplit | None = None
    ) -> DataFrame:
        reader = self._reader(spark).option("dbtable", self.name_of(table))
        if split is not None:
            reader = reader.options(**split.options())
        return normalise_columns(reader.load())

    def load_tables(
        self, spark: SparkSession, ticket_split: ReadSplit
    ) -> RawTables:
        """The raw tables as rows; Spark aggregates them itself.

        The tickets are always read over several connections: one alone would bring
        the whole fact through one task.
        """
        if ticket_split.partitions < 2:
            raise ValueError("tickets must be split over at least 2 partitions")
        splits = {"tickets": ticket_split}
        return RawTables(
            **{
                name: conform(self.table(spark, name, splits.get(name)), schema)
                for name, schema in RAW_TABLES.items()
            }
        )
