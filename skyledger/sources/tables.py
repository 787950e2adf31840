"""The raw star schema: one large fact (tickets) and two dimensions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.schemas import RAW_TABLES


@dataclass(frozen=True)
class RawTables:
    """The three tables; ``derived``: tickets come out of joins, so one reading is best."""

    tickets: DataFrame
    routes: DataFrame
    airports: DataFrame
    derived: bool = False

    def of_year(self, year: int) -> RawTables:
        """The same tables with the tickets of one year only.

        For monthly questions put to the tickets themselves. The range reaches
        the scan, where Parquet skips row groups by it; ``year(departure) = y``
        alone would read them all.
        """
        departure = F.col("departure")
        start, end = (
            F.lit(f"{y:04d}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1)
        )
        return replace(self, tickets=self.tickets.filter((departure >= start) & (departure < end)))


def normalise_columns(df: DataFrame) -> DataFrame:
    """Strip and lower-case the column names; values stay as they are."""
    names = [name.strip().lower() for name in df.columns]
    repeated = [name for name, n in Counter(names).items() if n > 1]
    if repeated:
        raise ValueError(f"columns {repeated} are ambiguous once lower-cased")
    return df.toDF(*names)


def _with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    df = normalise_columns(df)
    missing = [name for name in schema.names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Pick the columns of ``schema`` and cast those of another kind.

    A decimal keeps the precision and scale of its source, so no digit is lost;
    a column that already fits is passed through bare, so filters on it still
    reach the scan. A double becomes a decimal only where it is the same number in
    both; any other value is an error that names the column.
    """
    df = _with_columns(df, schema)

    def column(field: T.StructField):
        present = df.schema[field.name].dataType
        if type(present) is type(field.dataType):
            return F.col(field.name)
        if isinstance(present, T.FractionalType) and isinstance(field.dataType, T.DecimalType):
            return _exact_decimal(field, present).alias(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[column(field) for field in schema.fields])


def _exact_decimal(field: T.StructField, present: T.DataType) -> Column:
    """The values of a floating-point column as decimals that read back equal.

    With the scale of ``field`` and as many digits as a double has.
    """
    value, kind = F.col(field.name), _wide(field)
    exact = value.try_cast(kind)
    refused = F.concat(
        F.lit(f"column {field.name}: "), value.cast("string"), F.lit(f" is not a {kind.simpleString()}")
    )
    fits = value.isNull() | F.coalesce(exact.cast(present) == value, F.lit(False))
    return F.when(fits, exact).otherwise(F.raise_error(refused).cast(kind))


def _wide(field: T.StructField) -> T.DecimalType:
    return T.DecimalType(max(18, field.dataType.precision), field.dataType.scale)


# Why a value is rejected.
NOT_FINITE, TOO_LARGE, NOT_EXACT = "not finite", "too large", "not exact"
REJECTS = "table string, faults array<struct<column: string, value: string, reason: string>>, row string"


def _tried(field: T.StructField, present: T.DataType) -> tuple[Column, Column | None]:
    """A column in its type, null where it does not fit; and why it does not, or null."""
    value = F.col(field.name)
    if type(present) is type(field.dataType):
        return value, None
    if isinstance(present, T.FractionalType) and isinstance(field.dataType, T.DecimalType):
        exact = value.try_cast(_wide(field))
        infinite = F.isnan(value) | (F.abs(value) == F.lit(float("inf")).cast(present))
        reason = (
            F.when(infinite, NOT_FINITE).when(exact.isNull(), TOO_LARGE).when(exact.cast(present) != value, NOT_EXACT)
        )
    else:
        exact = value.try_cast(field.dataType)
        reason = F.when(exact.isNull(), f"not a {field.dataType.simpleString()}")
    return F.when(reason.isNull(), exact), F.when(value.isNotNull(), reason)


def conform_checked(df: DataFrame, schema: T.StructType, table: str) -> tuple[DataFrame, DataFrame]:
    """``conform`` without its errors: the rows that fit, and the rejected ones.

    A rejected row has its ``faults`` (column, value as text, reason), at least one, and
    all its columns as JSON. The rows that fit are those and such as ``conform`` gives.
    """
    df = _with_columns(df, schema)
    tried = {field.name: _tried(field, df.schema[field.name].dataType) for field in schema.fields}
    checked = {name: reason for name, (_, reason) in tried.items() if reason is not None}
    values = [value.alias(name) for name, (value, _) in tried.items()]
    if not checked:  # every column has its type already
        return df.select(*values), df.sparkSession.createDataFrame([], REJECTS)
    fits = reduce(and_, [reason.isNull() for reason in checked.values()])
    faults = [
        F.when(
            reason.isNotNull(),
            F.struct(F.lit(name).alias("column"), F.col(name).cast("string").alias("value"), reason.alias("reason")),
        )
        for name, reason in checked.items()
    ]
    rejects = df.filter(~fits).select(
        F.lit(table).alias("table"),
        F.array_compact(F.array(*faults)).alias("faults"),
        F.to_json(F.struct(*map(F.col, df.columns))).alias("row"),
    )
    return df.filter(fits).select(*values), rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(table, column, reason, rows): how many rows each reason has."""
    one = rejects.select("table", F.explode("faults").alias("fault"))
    keys = ["table", F.col("fault.column").alias("column"), F.col("fault.reason").alias("reason")]
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).orderBy("table", "column", "reason")


def load_checked_tables(spark: SparkSession, folder: str) -> tuple[RawTables, DataFrame]:
    """``load_tables`` without the rows that do not fit, and these.

    The rejects are a plan of their own: asking for them reads the tables once more,
    leaving them unasked costs nothing.
    """
    found = {
        name: conform_checked(spark.read.parquet(f"{folder}/{name}.parquet"), schema, name)
        for name, schema in RAW_TABLES.items()
    }
    tables = RawTables(**{name: good for name, (good, _) in found.items()})
    return tables, reduce(DataFrame.unionAll, [rejects for _, rejects in found.values()])


def load_tables(spark: SparkSession, folder: str) -> RawTables:
    """Tickets, routes and airports as Parquet datasets ``<folder>/<table>.parquet``."""
    return RawTables(
        **{
            name: conform(spark.read.parquet(f"{folder}/{name}.parquet"), schema)
            for name, schema in RAW_TABLES.items()
        }
    )
