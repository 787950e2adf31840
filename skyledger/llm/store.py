"""Tables that an operator writes once and reads again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from skyledger.plans import scratch_folder

#: Row groups of tables of large rows: a task that writes or reads one holds it in memory.
ROW_GROUP = 16 << 20


#: The tables written inside each open ``cleared``.
_MADE: list[list[str]] = []


def _put(df: DataFrame, name: str, options: dict) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    if _MADE:
        _MADE[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, for large rows; and the folder, for ``remove``."""
    return _put(df, name, {"parquet.block.size": ROW_GROUP, "compression": "zstd"})


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to a new folder beside the checkpoints.

    All executors share that folder (``spark.checkpoint.dir``), so what is read from
    it does not depend on any executor that computed it.
    """
    return _put(df, name, {})[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written_at`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written inside, whether it ends well or not.

    For jobs whose result is written inside to a folder of its own (``kept``).
    """
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(spark, path)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, for a table that outlives the ``cleared`` around it; and its folder."""
    found, path = _put(df, name, {})
    if _MADE:
        _MADE[-1].remove(path)
    return found, path


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python workers in batches of 4 MB or 1000 rows.

    Spark's own sizes (64 MB, 10,000 rows) are held several times over by each worker
    and by its task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
