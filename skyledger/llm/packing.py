"""Token ids packed into rows of one length, ready for training.

Documents become token ids with an end token each. A document longer than a row is cut
into pieces of one row and a rest, so no token is lost. Each task gathers pieces up to
``BUFFER`` tokens and packs them by best-fit decreasing: the longest piece first, each
into the fullest row that still has room. A segment tree over the free lengths of rows
finds it in the logarithm of the row length. Packing inside tasks needs no shuffle, and
no group, host or source can make a task larger; each buffer leaves at most its last
rows unfilled.

A packed row has its ids and the position of each token in its segment (both binary,
little-endian, padded), the cumulative lengths of its segments from 0, and, for each
segment, its document and its place there: ``unpacked`` gives the documents back.

Null and empty texts are just their end token. Repeated rows are packed each. An empty
table gives an empty result. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.bpe import Vocabulary
from skyledger.llm.words import chunks

#: Tokens that a task packs at a time.
BUFFER = 2 << 20
_ROWS = 256  # packed rows in one Arrow batch

SCHEMA = (
    "pack_id long, n_tokens int, dtype string, ids binary, positions binary,"
    " cu_seqlens array<int>, doc_ids array<long>, offsets array<long>"
)
_ARROW = pa.schema(
    [
        ("pack_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("dtype", pa.string()),
        ("ids", pa.binary()),
        ("positions", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
    ]
)


class Piece(NamedTuple):
    doc_id: int | None
    offset: int
    ids: np.ndarray


class FreeLengths:
    """Open rows by free length, in a segment tree that knows where there are any."""

    def __init__(self, longest: int) -> None:
        self.width = 1 << longest.bit_length()
        self.tree = bytearray(2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = free + self.width
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, free: int) -> int:
        """A row with just this free length."""
        row = self.rows[free].pop()
        if not self.rows[free]:
            node = free + self.width
            self.tree[node] = 0
            node >>= 1
            while node and not (self.tree[2 * node] or self.tree[2 * node + 1]):
                self.tree[node] = 0
                node >>= 1
        return row

    def least(self, needed: int) -> int | None:
        """The least free length of ``needed`` or more that some row has."""
        node = needed + self.width
        while not self.tree[node]:
            while node & 1:  # up while this is a right child, then to the neighbour
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(sizes: Sequence[int], length: int) -> list[list[int]]:
    """Rows as lists of places in ``sizes``, each at most ``length``; equal sizes in order."""
    free, rows = FreeLengths(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = free.least(sizes[i])
        if room is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            row = free.take(room)
        rows[row].append(i)
        if room > sizes[i]:
            free.add(room - sizes[i], row)
    return rows


def _packed(pieces: list[Piece], length: int, pad: int, dtype: np.dtype, first: int) -> Iterator[pa.RecordBatch]:
    rows = best_fit_decreasing([len(p.ids) for p in pieces], length)
    small = np.dtype("<u2") if length <= 1 << 16 else np.dtype("<u4")
    for at in range(0, len(rows), _ROWS):
        columns: list[list] = [[] for _ in _ARROW]
        for k, row in enumerate(rows[at : at + _ROWS], first + at):
            own = [pieces[i] for i in row]
            ids, positions = np.full(length, pad, dtype), np.zeros(length, small)
            ends = np.cumsum([0, *(len(p.ids) for p in own)])
            for p, a, b in zip(own, ends[:-1], ends[1:], strict=True):
                ids[a:b] = p.ids
                positions[a:b] = np.arange(b - a)
            values = (
                k, int(ends[-1]), dtype.str, ids.tobytes(), positions.tobytes(), ends,
                [p.doc_id for p in own], [p.offset for p in own],
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )


def pack(
    docs: DataFrame,
    vocabulary: Vocabulary,
    length: int,
    end_id: int,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Packed rows of ``length`` tokens; ``end_id`` ends each document and fills rows up."""
    dtype = np.dtype("<u2") if max(int(vocabulary.ids.max()), end_id) < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        pieces: list[Piece] = []
        held = 0
        for part, texts in chunks(batches):
            values, at = vocabulary.encode(texts, together=True)
            values = np.insert(values, at[1:], end_id).astype(dtype)
            ends = (at[1:] + np.arange(1, len(at))).tolist()
            begin = 0
            for doc_id, end in zip(part.column("doc_id").to_pylist(), ends, strict=True):
                for offset in range(0, end - begin, length):
                    pieces.append(Piece(doc_id, offset, values[begin + offset : min(begin + offset + length, end)]))
                begin = end
            held += len(values)
            if held >= BUFFER:
                for batch in _packed(pieces, length, end_id, dtype, first):
                    first += batch.num_rows
                    yield batch
                pieces, held = [], 0
        yield from _packed(pieces, length, end_id, dtype, first)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def segments(packs: DataFrame) -> DataFrame:
    """A row for each segment: doc_id, its place in the document, and its ids (binary)."""
    width = F.when(F.col("dtype") == "<u2", 2).otherwise(4)
    one = F.explode(
        F.arrays_zip(
            F.col("doc_ids").alias("doc_id"),
            F.col("offsets").alias("offset"),
            F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("begin"),
            F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("end"),
        )
    )

    def cut(begin: Column, end: Column) -> Column:
        return F.substring("ids", begin * width + 1, (end - begin) * width)

    return packs.select("dtype", "ids", one.alias("s")).select(
        "s.doc_id", "s.offset", "dtype", cut(F.col("s.begin"), F.col("s.end")).alias("ids")
    )
