"""Benchmark items inside documents: SimHash windows, Hamming blocks, exact proof.

An item and a window are weighted sets of five-word shingles (of lower-cased words; a
text of one to four words is one shingle). A window is as long as the item it is
compared with, or the whole document where that is shorter. A shingle that occurs w times
in a window is w elements, numbered from 1, so a weighted set is a plain one and its
similarity the share of elements in common. The fingerprint of a window has BITS bits, each
the sign of a sum over its elements; sliding sums give it at every place, as a step
takes the highest number of one shingle out and puts one more of another in.

Fingerprints of items are indexed in blocks of 8 bits. Within RADIUS bits in all, some
block differs in at most RADIUS // BLOCKS bits, so looking up every block with that
tolerance finds all fingerprints within the radius, without exception. Each candidate is
then compared shingle by shingle with its weights: shared weight over joint weight, at
least 0.75. Nothing else makes a hit.

At a similarity of 0.75 fingerprints differ in 88 of 512 bits on average with a deviation of
8.5, so RADIUS is 4.5 deviations above: some 3 pairs in a million at the limit lie
beyond, and repeated shingles are no exception, being elements of their own.

A window without any shingle of an item has similarity 0 with it. So windows are made
only around shingles that occur in some item, which loses nothing and leaves most
documents with a look at one table.

The items are a stated set of queries. They are taken in blocks whose index has a fixed
size, so a larger benchmark means more readings of the documents and no larger tasks.

Null and blank texts have no windows; an item of one to four words is found only in a
document that has just these words; equal items are found each; repeated rows give their
hits each; empty tables on either side give no hits. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import Texts, chunks, mixed, shingles

SIMILAR_PERCENT = 75
BITS = 512
BLOCKS = 64
RADIUS = 127
#: Items and shingles in one index, which is sent to all tasks.
INDEX_ITEMS = 10_000
INDEX_SHINGLES = 1_000_000
_WINDOWS = 4096  # made at a time

_LANES = np.random.default_rng(512).integers(1, 1 << 63, BITS // 64, dtype=np.uint64) * 2 + 1
_BYTES = np.arange(256, dtype=np.uint8)
_NEAR = np.bitwise_count(_BYTES[:, None] ^ _BYTES) <= RADIUS // BLOCKS


class Hit(NamedTuple):
    row: int
    item: int
    similarity: float
    place: int


_NUMBER = np.uint64(0x9E3779B97F4A7C15)


def numbers(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place: its shingle's number when a window comes to end there, and how many
    of it are in the window that begins there."""
    order = np.argsort(h, kind="stable")
    same = np.append(False, h[order][1:] == h[order][:-1])
    enter, leave = np.ones(len(h), np.int64), np.ones(len(h), np.int64)
    if same.any():
        # Places of one shingle after another's, too far apart for one window.
        group = np.cumsum(~same)
        key = group * (len(h) + size + 1) + order
        k = np.arange(len(h))
        enter[order] = k - np.searchsorted(key, key - size, "right") + 1
        leave[order] = np.searchsorted(key, key + size, "left") - k
    return enter, leave


def fingerprints(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each window h[s:s + size], as bytes."""
    enter, leave = numbers(h, size)
    repeats = bool((enter > 1).any())
    out = []

    def sums(number: np.ndarray, lane: np.uint64) -> np.ndarray:
        element = h + (number.astype(np.uint64) - np.uint64(1)) * _NUMBER
        spread = mixed(element * lane).view(np.uint8).reshape(-1, 8)
        signs = np.unpackbits(spread, axis=1).astype(np.int32) * 2 - 1
        return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])

    for lane in _LANES:
        came = sums(enter, lane)
        went = sums(leave, lane) if repeats else came
        out.append(np.packbits(came[starts + size] - went[starts] > 0, axis=1))
    return np.concatenate(out, axis=1)


def similarity(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Shared and joint weight of two windows; a shingle weighs as often as it occurs."""
    both, which = np.unique(np.concatenate([x, y]), return_inverse=True)
    a = np.bincount(which[: len(x)], minlength=len(both))
    b = np.bincount(which[len(x) :], minlength=len(both))
    return int(np.minimum(a, b).sum()), int(np.maximum(a, b).sum())


class Index:
    """Items by fingerprint blocks and by shingle."""

    def __init__(self, ids: list, items: list[np.ndarray]) -> None:
        self.ids, self.items = ids, items
        self.sizes = np.array([len(x) for x in items])
        self.words = -(-len(items) // 64)
        self.prints = np.concatenate(
            [fingerprints(x, np.zeros(1, np.int64), len(x)) for x in items]
        )
        # near[j, value]: the set of items whose block j is within the tolerance of value.
        self.near = np.empty((BLOCKS, 256, self.words), np.uint64)
        for j in range(BLOCKS):
            bits = np.zeros((256, self.words * 64), np.uint8)
            bits[:, : len(items)] = _NEAR[:, self.prints[:, j]]
            self.near[j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.of_size = {
            int(size): np.packbits(
                np.resize(self.sizes == size, len(items)).astype(np.uint8), bitorder="little"
            )
            for size in np.unique(self.sizes)
        }
        h = np.concatenate(items)
        owner = np.repeat(np.arange(len(items)), self.sizes)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
        self.shingles, self.owner = h[new], owner[new]  # each shingle of each item
        self.shift = np.uint64(64 - min(24, max(16, int(len(h)).bit_length() + 4)))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[self.shingles >> self.shift] = True

    def hits(self, texts: Texts) -> Iterator[Hit]:
        words = texts.words()
        h, at = shingles(words.hashes(), words.at)
        maybe = np.flatnonzero(self.filter[h >> self.shift])
        place = np.searchsorted(self.shingles, h[maybe])
        maybe = maybe[self.shingles[np.minimum(place, len(self.shingles) - 1)] == h[maybe]]
        row = np.searchsorted(at, maybe, "right") - 1
        for r in np.unique(row):
            own = h[at[r] : at[r + 1]]
            yield from self._hits_in(int(r), own, maybe[row == r] - at[r])

    def _hits_in(self, row: int, h: np.ndarray, anchors: np.ndarray) -> Iterator[Hit]:
        low = np.searchsorted(self.shingles, h[anchors], "left")
        high = np.searchsorted(self.shingles, h[anchors], "right")
        many = high - low
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(low, many) + step
        touched = self.owner[entry]
        best: dict[int, Hit] = {}
        for size in np.unique(self.sizes[touched]):
            length = min(int(size), len(h))
            # Starts of windows that cover an anchor.
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, np.maximum(anchors - length + 1, 0), 1)
            np.add.at(cover, anchors + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            starts = starts[starts <= len(h) - length]
            for i in range(0, len(starts), _WINDOWS):
                self._compare(row, h, starts[i : i + _WINDOWS], length, int(size), best)
        yield from best.values()

    def _compare(self, row, h, starts, length, size, best: dict[int, Hit]) -> None:
        base, to = starts[0], starts[-1] + length
        prints = fingerprints(h[base:to], starts - base, length)
        found = self.near[0][prints[:, 0]]
        for j in range(1, BLOCKS):
            found |= self.near[j][prints[:, j]]
        sets = found.view(np.uint8).reshape(len(starts), -1)[:, : len(self.of_size[size])]
        sets = sets & self.of_size[size]
        window, item = np.nonzero(np.unpackbits(sets, axis=1, bitorder="little"))
        far = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
        for w, k in zip(window[far <= RADIUS], item[far <= RADIUS], strict=True):
            s = int(starts[w])
            shared, joint = similarity(h[s : s + length], self.items[k])
            old = best.get(int(k))
            if 100 * shared >= SIMILAR_PERCENT * joint and (not old or shared / joint > old.similarity):
                best[int(k)] = Hit(row, int(k), shared / joint, s)


def item_shingles(benchmark: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, shingles): the hashes of each item in text order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = texts.words()
            h, at = shingles(words.hashes(), words.at)
            own = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id"), pa.array(own, pa.binary())], ["item_id", "shingles"]
            )

    rows = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item_id long, shingles binary").filter(F.octet_length("shingles") > 0)


def indexes(benchmark: DataFrame, id_column: str = "item_id", text: str = "text") -> Iterator[Index]:
    """One index after another; together they hold all items.

    Only one block of items, of a size that does not grow with the benchmark (but for
    one item longer than INDEX_SHINGLES), is on the driver at a time.
    """
    items = item_shingles(benchmark, id_column, text)
    total = items.agg(F.count("*"), F.sum(F.octet_length("shingles"))).first()
    blocks = max(-(-total[0] // INDEX_ITEMS), -(-(total[1] or 0) // (8 * INDEX_SHINGLES)))
    key = F.pmod(F.xxhash64("item_id", "shingles"), F.lit(max(1, blocks)))
    for block in range(blocks):
        rows = items.filter(key == block).toArrow()
        ids = rows.column("item_id").to_pylist()
        if ids:
            own = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            yield Index([ids[i] for i in order], [own[i] for i in order])


HITS = "doc_id long, item_id long, similarity double, first_word long"


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): the best window of each item in each document."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def search(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in chunks(batches):
                hits = list(index.hits(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([x.row for x in hits], pa.int64())),
                        pa.array([index.ids[x.item] for x in hits], pa.int64()),
                        pa.array([x.similarity for x in hits], pa.float64()),
                        pa.array([x.place for x in hits], pa.int64()),
                    ],
                    ["doc_id", "item_id", "similarity", "first_word"],
                )

        return rows.mapInArrow(run, HITS)

    found = [search(index) for index in indexes(benchmark)]
    none = docs.sparkSession.createDataFrame([], HITS)
    return reduce(DataFrame.unionAll, found) if found else none


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found."""
    for index in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for part, texts in chunks(batches, text):
                clean = np.ones(part.num_rows, bool)
                clean[[x.row for x in index.hits(texts)]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
