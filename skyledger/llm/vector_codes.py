"""Vectors as codes of their parts, from codebooks trained by ball k-means.

Components become whole numbers (floor of SCALE times the value) and a vector PARTS equal
parts in a row. Each position of a part has a codebook of up to ENTRIES entries, which
starts as that part of the vectors of the least ids. A round gives every part the nearest
entry (squared distance, ties to the lower index) and replaces each entry by the floored
mean of its parts; an unused one stays. All of it is whole numbers, so no result depends on
the order of rows or tasks.

The parts of one entry are a ball around it. With the distances between entries known,
a round compares a part only with what could be nearer:

* its entry's neighbours, those no further away than twice the ball's radius: any other is
  further from every part of the ball than the entry is;
* a part in the stable core, nearer to its entry than half the way to the first
  neighbour, with none;
* a part in the k-th ring, between half the ways to the k-th and the next neighbour, with
  the first k;
* where the entry has not moved since the last round, only with those that have: the
  others were further away before and still are.

Each comparison that is left out is proven to lose, ties included, so codes are those of
a full search. Balls are met by task: a task's share of a ball has a radius of its own,
which needs no pass over all parts. Only the first round, where no part has an entry yet,
compares with all entries. Codebooks (ENTRIES entries a position) and their sums are all
that is sent to tasks or to the driver; vectors and codes stay tables, written each round.

Vectors that are null, empty, hold null or non-finite components, or have not PARTS equal
parts are dropped, and those of another length than the first (by id) as well. Components
are held within what keeps squared distances in 64 bits (for 64 components beyond 131,072 in
absolute value). Repeated rows are coded each and count each; equal ids go by their
components; a null id comes last. Null labels are together. Empty tables give an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.store import remove, written, written_at

SCALE = 1024
PARTS = 4
ENTRIES = 256  # a code is one byte
ROUNDS = 4
_HELD = 16_384  # vectors of a task that are compared together
_FAR = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """vec_id, label and the whole components (bytes of ints) of every vector that is kept."""
    kind = rows.schema[label].dataType
    schema = T.StructType().add("vec_id", "long").add("label", kind).add("x", "binary")
    rows = rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")
    ).filter(F.size("v") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            flat = pc.cast(column.flatten(), pa.float64())
            x = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(row[~np.isfinite(x)], minlength=len(size)) > 0
            bad |= size % PARTS > 0
            # For squared distances of whole vectors to stay below 2 ** 62.
            most = np.floor(np.sqrt(2.0**60 / size))[row]
            with np.errstate(over="ignore", invalid="ignore"):
                z = np.nan_to_num(np.clip(np.floor(x * SCALE), -most, most)).astype(np.int32)
            own = [z[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)]
            out = [batch.column("vec_id"), batch.column("label"), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "x"]).filter(pa.array(~bad))

    return rows.mapInArrow(run, schema)


class Codebook:
    """Entries of one part position, and for each its others by distance."""

    def __init__(self, entries: np.ndarray, before: Codebook | None = None) -> None:
        self.entries = entries
        self.moved = np.ones(len(entries), bool) if before is None else (entries != before.entries).any(axis=1)
        apart = distances(entries, entries)
        np.fill_diagonal(apart, _FAR)  # last, and in no ring
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:  # doubles hold every sum exactly
        a, b = x.astype(np.float64), entries.astype(np.float64)
        out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return out.astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for column, other in zip(x.T, entries.T, strict=True):
        out += (column[:, None] - other) ** 2
    return out


def nearest(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, of all entries, and its distance."""
    code, far = np.empty(len(x), np.uint8), np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        d = distances(x[i : i + 4096], book.entries)
        at = d.argmin(axis=1)  # the first of equals
        code[i : i + 4096], far[i : i + 4096] = at, d[np.arange(len(at)), at]
    return code, far


def nearer(x: np.ndarray, code: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """``nearest``, for parts whose ``code`` was the nearest entry a round ago."""
    far = ((x - book.entries[code]) ** 2).sum(axis=1)
    out, least = code.copy(), far.copy()
    order = np.argsort(code, kind="stable")
    begins = np.searchsorted(code[order], np.arange(len(book.entries) + 1))
    for i in np.flatnonzero(np.diff(begins)):
        ball = order[begins[i] : begins[i + 1]]
        # How many neighbours are within twice a part's distance; none in the stable core.
        ring = np.searchsorted(book.apart[i], 4 * far[ball], "right")
        neighbours = book.order[i][: ring.max()]  # of the whole ball: by its radius
        place = np.arange(len(neighbours))
        if not book.moved[i]:
            place = np.flatnonzero(book.moved[neighbours])
        # Rings are taken together up to twice the number of neighbours.
        low = 0
        while low < len(place):
            high = min(len(place), max(4, 2 * low))
            own = np.flatnonzero(ring > place[low])
            some = neighbours[place[low:high]]
            rows = ball[own]
            d = distances(x[rows], book.entries[some])
            d[place[low:high] >= ring[own, None]] = _FAR  # beyond its ring
            best = d.min(axis=1, initial=_FAR)
            index = np.where(d == best[:, None], some, ENTRIES).min(axis=1)
            better = (best < least[rows]) | ((best == least[rows]) & (index < out[rows]))
            out[rows[better]], least[rows[better]] = index[better], best[better]
            low = high
    return out, least


def _held(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.Table]:
    parts, n = [], 0
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= wanted:
            yield pa.Table.from_batches(parts)
            parts, n = [], 0
    if n:
        yield pa.Table.from_batches(parts)


def _vectors(table: pa.Table) -> np.ndarray:
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.int32)
    return x.reshape(table.num_rows, -1).astype(np.int64)


def _assigned(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """``rows`` with their codes by ``books`` (one byte a part) and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, _HELD):
            x = _vectors(table)
            width = x.shape[1] // PARTS
            before = None
            if "code" in table.column_names:
                before = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            codes, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                part = x[:, p * width : (p + 1) * width]
                found = nearest(part, book) if before is None else nearer(part, before[:, p], book)
                codes[:, p] = found[0]
                error += found[1]
            new = {"code": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error)}
            table = table.select(["vec_id", "label", "x"])
            for name, column in new.items():
                table = table.append_column(name, column)
            yield from table.to_batches(max_chunksize=1000)

    schema = rows.select("vec_id", "label", "x").schema.add("code", "binary").add("error", "long")
    return rows.mapInArrow(run, schema)


def _moved(rows: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks with each used entry as the floored mean of its parts."""
    width = books[0].entries.shape[1]
    size = len(books[0].entries)
    names = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((PARTS * size, width), np.int64), np.zeros(PARTS * size, np.int64)
        for table in _held(batches, _HELD):
            x = _vectors(table).reshape(-1, PARTS, width)
            codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                at = p * size + codes[:, p].astype(np.int64)
                order = np.argsort(at, kind="stable")
                begins = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
                sums[at[order][begins]] += np.add.reduceat(x[order, p], begins, axis=0)
                n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        columns = [used, n[used], *sums[used].T.copy()]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["entry", "n", *names])

    schema = ", ".join(f"{c} long" for c in ["entry", "n", *names])
    # Sums as decimals: a hot entry of many far parts may pass 64 bits.
    total = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ["n", *names]]
    table = rows.select("x", "code").mapInArrow(run, schema).groupBy("entry").agg(*total).collect()
    entries = np.stack([b.entries for b in books]).reshape(PARTS * size, width).copy()
    for row in table:
        entries[row.entry] = [int(row[c]) // int(row.n) for c in names]
    return [Codebook(e, b) for e, b in zip(entries.reshape(PARTS, size, width), books, strict=True)]


def codebooks_text(books: list[Codebook]) -> str:
    """All components by part, entry and position."""
    return ",".join(str(x) for book in books for x in book.entries.ravel().tolist())


def train(vectors: DataFrame) -> tuple[list[Codebook], DataFrame] | None:
    """The codebooks after ROUNDS rounds, and the vectors with their codes by these."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").toArrow()
    if not first.num_rows:
        return None
    start = _vectors(first)
    width = start.shape[1] // PARTS
    books = [Codebook(start[:, p * width : (p + 1) * width].copy()) for p in range(PARTS)]
    rows, path = written_at(_assigned(vectors, books), "vector-codes")
    for _ in range(ROUNDS):
        books = _moved(rows, books)
        last = path
        rows, path = written_at(_assigned(rows, books), "vector-codes")
        remove(vectors.sparkSession, last)  # the new table has all of it
    return books, rows


def compress(
    rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept."""
    vectors = written(whole_vectors(rows, id_column, vector, label), "whole-vectors")
    # One length for all: that of the first vector.
    one = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.octet_length("x").alias("n")).first()
    found = train(vectors.filter(F.octet_length("x") == (one.n if one else 0)))
    if found is None:
        none = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], none)
    books, coded = found
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    most = F.lit(_FAR).cast("decimal(38,0)")
    of_label = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(of_label), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )
