"""A bit map of hashes, of fixed size, that lets tasks pass over rows no other side has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: The map is sent to all tasks (1 MB). A hash in it may be another's: a join follows.
MAP_BITS = 1 << 23
#: A name that no table of documents has.
HASH = "__hash"


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A bit for each value of the column ``h`` (long) modulo MAP_BITS.

    What is sent to the driver is at most MAP_BITS / 64 rows.
    """
    place = f"pmod(h, {MAP_BITS}L)"
    rows = (
        hashes.selectExpr(f"cast({place} div 64 as int) w", f"shiftleft(1L, cast({place} % 64 as int)) b")
        .groupBy("w")
        .agg({"b": "bit_or"})
        .toDF("w", "bits")
        .toArrow()
    )
    words = np.zeros(MAP_BITS // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


def in_map(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the map has the bit of each of the signed 64-bit ``hashes``."""
    place = hashes.view(np.uint64) % np.uint64(MAP_BITS)
    return ((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def of_map(rows: DataFrame, h: Column, bits: np.ndarray, there: bool) -> DataFrame:
    """The ``rows`` whose hash ``h`` (long, not null) is in the map, or those whose is not."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = in_map(batch.column(HASH).to_numpy(zero_copy_only=False), bits) == there
            yield batch.select(names).filter(pa.array(fits))

    return rows.withColumn(HASH, h).mapInArrow(run, rows.schema)
