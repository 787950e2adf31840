"""Marts in buckets of their route code.

The marts that answers join are both hashed by route code when they are written, one
sorted file for each bucket. Read as such, neither the grouping by route nor the join of
groups and routes moves a row, whatever their size; read as plain Parquet they are
the same rows. Spark keeps the layout of a table with its name, so writing and
reading go through table names of this session; the files are where every mart is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

#: The marts that meet on this column.
BUCKET_COLUMN = "route_code"
BUCKETED_MARTS = ("routes_with_airports", "revenue_by_route_class")


def _name(path: str) -> str:
    return f"skyledger_mart_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_in_buckets(df: DataFrame, path: str, buckets: int) -> None:
    """Write ``df`` to ``path`` as ``buckets`` files, each sorted by the bucket column."""
    spark, name = df.sparkSession, _name(path)
    try:
        (
            df.repartition(buckets, BUCKET_COLUMN)
            .write.bucketBy(buckets, BUCKET_COLUMN)
            .sortBy(BUCKET_COLUMN)
            .option("path", path)
            .saveAsTable(name, format="parquet")
        )
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name only: the files are its own path's


def read_in_buckets(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The table that ``write_in_buckets`` wrote to ``path``, with its layout."""
    name = _name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
        f" CLUSTERED BY ({BUCKET_COLUMN}) SORTED BY ({BUCKET_COLUMN}) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    return spark.table(name)
