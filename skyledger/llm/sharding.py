"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are ordered by id, then by size and checksum. A range partitioning on that order
gives each partition a stretch of it; the totals of the partitions (one row each) are
summed up, and each row's place is the sum before its partition plus the sum before
it inside. Shard k takes the rows whose middle byte lies in the k-th of n equal parts
of all bytes, so shards are stretches of the order and each differs from an equal
share by less than the largest document. No task ever holds a shard or all rows.

Null ids come first and null texts have no bytes. Rows with equal id, size and
checksum are interchangeable: which of them takes which slot is open, their number
in each shard is not. An empty table gives an empty result. A table with one huge
document can leave shards empty, as documents are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyledger.llm.store import written

#: What a document costs besides its text, in bytes.
OVERHEAD = 8


def document_sizes(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size (UTF-8 bytes of the text plus OVERHEAD) and checksum of every row."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(content).cast("long") + OVERHEAD).alias("size"),
        F.crc32(content).alias("text_crc32"),
    )


def assign_shards(sizes: DataFrame, n_shards: int) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (0 and up inside each shard)."""
    columns = ["doc_id", "size", "text_crc32"]
    # Equal rows are interchangeable: a number drawn for each, kept by writing it, lets the
    # ranges cut through them, however many there are.
    order = [*columns, "_spread"]
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = written(sizes.withColumn("_spread", F.rand(24)), "shard-sizes")
    placed = written(
        drawn.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()),
        "shard-rows",
    )
    # One row per partition: the window over all of them is as small as their number.
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), zero).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), zero).alias("_rows_before"),
        F.sum("_bytes").over(W.partitionBy()).alias("_all"),
    )
    inside = W.partitionBy("_part").orderBy(*order)
    rows = (
        placed.withColumn("_sum", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, "_part")
    )
    # Twice the middle byte's place times the shards, over twice all bytes: whole numbers.
    middle = 2 * (F.col("_bytes_before") + F.col("_sum")) - F.col("size")
    rows = written(
        rows.select(
            *columns,
            (F.col("_rows_before") + F.col("_row")).alias("_place"),
            F.expr("_all").alias("_all"),
            middle.alias("_middle"),
        )
        .withColumn("shard", F.expr(f"cast((_middle * {n_shards}) div (2 * _all) as int)"))
        .drop("_all", "_middle"),
        "shard-places",
    )
    starts = rows.groupBy("shard").agg(F.min("_place").alias("_start"))
    return rows.join(starts, "shard").select(
        *columns, "shard", (F.col("_place") - F.col("_start")).alias("slot")
    )
