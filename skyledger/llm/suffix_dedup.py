"""Bytes of texts that repeat a passage of a document with a smaller id, taken out.

A byte goes if some string of LENGTH bytes that covers it also starts in a document with
a smaller id. Whether a string does is found by sorting suffixes, cut to what decides it, in
a distributed merge sort that knows common prefixes:

1. Documents become runs of about RUN bytes. Of the grams of GRAM bytes in each string the
   one of least hash is its anchor, so a string has the same anchor wherever it occurs.
   Strings that begin one after another and share an anchor are one block: the text from
   the first to the last of them, some 13 suffixes in about 62 bytes.
2. Hashes of anchors are exchanged, sorted and packed. A string that occurs in two
   documents has an anchor that does, so blocks of other anchors cannot matter and are left
   out here; a collision of hashes only keeps a block in.
3. Each run sorts its blocks as suffixes from their anchor on (what is left of the anchor
   comes after them), once each with the least id, and front-codes them: the length of the
   prefix in common with the block before, and the rest. Splitters taken from a sample cut
   the sorted runs into ranges, which are exchanged in this form.
4. The runs of a range meet in a loser tree that holds the common prefix of each
   contender with the last winner: a longer one wins unread, and only equal ones are
   read, from there on. Equal blocks come out side by side, and their least id goes
   back to the runs: what occurs with a larger id goes as a whole.
5. Blocks that share an anchor and are not equal (at the ends of a passage) may still have
   strings in common. They are side by side too, and their strings are sorted where they
   are. Only where a border of ranges goes through such blocks, as it must if there are
   more than a range holds, their strings, once for each block, are sorted runs of the
   same kind that go through the same exchange and merge.

A range holds about RANGE blocks whatever the number of documents, a passage that all
documents have is one block of each run, and nothing but splitters (one for each range)
reaches the driver. No string is capped or sampled, and blocks are compared in whole.

Matches never cross documents. Null and empty texts have no bytes; a text shorter than LENGTH
keeps all of its own. A null id is larger than any other, and rows of equal id are never
a smaller document to each other, so repeated rows keep what only they have. A very long
text is a run by itself. An empty table gives an empty result. Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import remove, written_at
from skyledger.llm.words import _BASE, _INVERSE, _VALUES, CHUNK, Texts, _powers, mixed, texts_of

LENGTH = 50
GRAM = 26
SIDE = LENGTH - GRAM  # most bytes of a block before its anchor, and after it
#: Bytes of a block as it is sorted: anchor, lengths of both sides, right and left side.
BLOCK = GRAM + 2 + 2 * SIDE
#: Bytes of text in a run; one longer text is a run.
RUN = 4 << 20
#: Hashes in a group, and blocks or strings in a range.
GROUP, RANGE = 1_000_000, 150_000
#: Blocks of which all strings are held at once.
_HELD = 16_384
#: One in so many blocks of a run is in the sample that ranges are cut by.
STEP = 256

_KEY_BYTES = 5
_LAST = (1 << 63) - 1
_ORDER = np.uint64(0xD6E8FEB86659FD93)


# Anchors and blocks of a run.


def _gram_sums(b: np.ndarray) -> np.ndarray:
    """A polynomial of each gram."""
    n = len(b)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[b] * _powers(_BASE, n), out=sums[1:])
    return (sums[GRAM:] - sums[:-GRAM]) * _powers(_INVERSE, n)[: n - GRAM + 1]


def gram_hashes(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the gram that begins at each of ``at``, which is in order."""
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(b), CHUNK):
        i, j = np.searchsorted(at, [low, low + CHUNK])
        if i < j:
            out[i:j] = mixed(_gram_sums(b[low : low + CHUNK + GRAM - 1])[at[i:j] - low])
    return out


def _anchors(b: np.ndarray) -> np.ndarray:
    """How far after the start of each string its anchor is, as if all were one text."""
    out = np.empty(max(0, len(b) - LENGTH + 1), np.uint8)
    low32 = np.uint64(0xFFFFFFFF)
    for low in range(0, len(out), CHUNK):
        y = _gram_sums(b[low : low + CHUNK + LENGTH - 1]) * _ORDER
        y = (y & ~low32) | np.arange(len(y), dtype=np.uint64)  # the first of equals
        width = 1
        while 2 * width <= SIDE + 1:
            y = np.minimum(y[:-width], y[width:])
            width *= 2
        if rest := SIDE + 1 - width:
            y = np.minimum(y[:-rest], y[rest:])
        out[low : low + len(y)] = (y & low32) - np.arange(len(y), dtype=np.uint64)
    return out


def blocks_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """How many strings each block has, and how far its anchor is after its start."""
    count = np.maximum(np.diff(texts.at) - LENGTH + 1, 0)
    if not count.sum():
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    off = _anchors(texts.bytes)
    own = zip(texts.at[:-1].tolist(), count.tolist(), strict=True)
    off = np.concatenate([off[start : start + n] for start, n in own if n])
    new = np.append(True, off[:-1] != off[1:] + 1)
    new[(np.cumsum(count) - count)[count > 0]] = True
    begins = np.flatnonzero(new)
    return np.diff(np.append(begins, len(off))).astype(np.uint8), off[begins]


def _starts(n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each block begins, and the document it is of; ``at``: where documents begin."""
    count = np.maximum(np.diff(at) - LENGTH + 1, 0)
    until = np.cumsum(count)
    begin = np.cumsum(n.astype(np.int64)) - n
    doc = np.searchsorted(until, begin, "right")
    return begin + (at[:-1] - (until - count))[doc], doc


def _runs(docs: DataFrame) -> DataFrame:
    """(run, ids, at, text, n, off): documents and blocks of each run."""

    def row(run: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy()
        texts = texts_of(table.column("text").combine_chunks())
        n, off = blocks_of(texts)
        columns = [ids.astype(np.int64).tobytes(), texts.at.tobytes(), _packed(texts.bytes.tobytes()), n.tobytes(), off.tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([run]), *[pa.array([c], pa.binary()) for c in columns], pa.array([len(n)])],
            ["run", "ids", "at", "text", "n", "off", "n_blocks"],
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 33
        parts, held = [], 0
        for batch in batches:
            size = np.diff(texts_of(batch.column("text")).at)
            i = 0
            while i < batch.num_rows:
                until = held + np.cumsum(size[i:])
                j = i + max(int(np.searchsorted(until, RUN, "right")), 0 if parts else 1)
                if j > i:
                    parts.append(batch.slice(i, j - i))
                    held = int(until[j - i - 1])
                if j < batch.num_rows:
                    yield row(run, parts)
                    run, parts, held = run + 1, [], 0
                i = j
        if parts:
            yield row(run, parts)

    schema = "run long, ids binary, at binary, text binary, n binary, off binary, n_blocks long"
    return docs.mapInArrow(make, schema)


def _array(batch, name: str, kind, row: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_py() or b"", kind)


def _packed(content) -> bytes:
    """Bytes as they go through shuffles and files."""
    return pa.compress(content, codec="zstd", asbytes=True)


def _unpacked(content: bytes, size: int) -> np.ndarray:
    if not size:
        return np.zeros(0, np.uint8)
    return np.frombuffer(pa.decompress(content, size, codec="zstd", asbytes=True), np.uint8)


def _text(batch, row: int, at: np.ndarray) -> np.ndarray:
    return _unpacked(batch.column("text")[row].as_py(), int(at[-1]))


# Which anchors occur in more than one document.


def _keys(b: np.ndarray, x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the anchors at ``x`` (group in the high bits), and the key of each."""
    h = gram_hashes(b, x)
    key = (h // np.uint64(groups)) & np.uint64((1 << 8 * _KEY_BYTES) - 1)
    return np.unique((h % np.uint64(groups)) << np.uint64(8 * _KEY_BYTES) | key, return_inverse=True)


def _cuts(distinct: np.ndarray, groups: int) -> np.ndarray:
    return np.searchsorted(distinct, np.arange(groups + 1, dtype=np.uint64) << np.uint64(8 * _KEY_BYTES))


def _shared_anchors(runs: DataFrame, groups: int) -> DataFrame:
    """(run, shared): for each group, a bit for each of the run's keys in it."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, off, at = (_array(batch, c, t, k) for c, t in (("n", np.uint8), ("off", np.uint8), ("at", np.int64)))
                start, doc = _starts(n, at)
                distinct, which = _keys(_text(batch, k, at), start + off, groups)
                order = np.argsort(which, kind="stable")
                ends = np.cumsum(np.bincount(which, minlength=len(distinct)))
                first = np.append(0, ends[:-1])
                # Documents are in order, so the first and last of a key's tell if it has two.
                many = doc[order[first]] != doc[order[ends - 1]] if len(order) else np.zeros(0, bool)
                packed = distinct.view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
                cut = _cuts(distinct, groups)
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used),
                        pa.array(np.repeat(batch.column("run")[k].as_py(), len(used))),
                        pa.array([packed[cut[g] : cut[g + 1]].tobytes() for g in used], pa.binary()),
                        pa.array([np.packbits(many[cut[g] : cut[g + 1]]).tobytes() for g in used], pa.binary()),
                    ],
                    ["part", "run", "keys", "many"],
                )

    def meet(table: pa.Table) -> pa.Table:
        packed = [np.frombuffer(x, np.uint8).reshape(-1, _KEY_BYTES) for x in table.column("keys").to_pylist()]
        sizes = [len(x) for x in packed]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :_KEY_BYTES] = np.concatenate(packed)
        many = np.concatenate(
            [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(table.column("many").to_pylist(), sizes, strict=True)]
        ).astype(bool)
        distinct, which = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        shared = np.bincount(which, minlength=len(distinct)) > 1
        shared[which[many]] = True
        ends = np.cumsum(sizes)
        bits = [np.packbits(shared[which[e - n : e]]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.table(
            {"run": table.column("run"), "part": table.column("part"), "shared": pa.array(bits, pa.binary())}
        )

    rows = runs.select("run", "at", "text", "n", "off").mapInArrow(
        keys, "part long, run long, keys binary, many binary"
    )
    bits = rows.groupBy("part").applyInArrow(meet, "run long, part long, shared binary")
    return bits.groupBy("run").agg(F.collect_list(F.struct("part", "shared")).alias("shared"))


# Sorted, front-coded runs of strings of one width.


def sorted_distinct(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows in order, their common prefixes, least ids, and each row's place there."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    order = np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1])
    rows = rows[order]
    common = np.zeros(n, np.int64)
    other = rows[1:] != rows[:-1]
    common[1:] = np.where(other.any(axis=1), other.argmax(axis=1), width)
    first = np.flatnonzero(common < width)
    least = np.minimum.reduceat(ids[order], first) if n else ids
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(common < width) - 1
    return rows[first], common[first].astype(np.uint8), least, place


def front_coded(rows: np.ndarray, common: np.ndarray) -> tuple[bytes, bytes]:
    """The common prefixes, the first of none, and the rest of each row, packed."""
    common = common.copy()
    common[:1] = 0
    return common.tobytes(), _packed(rows[np.arange(rows.shape[1]) >= common[:, None]].tobytes())


def decoded(common: bytes, rest: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and common prefixes that ``front_coded`` had."""
    prefix = np.frombuffer(common, np.uint8)
    own = np.arange(width) >= prefix[:, None]
    rows = np.zeros(own.shape, np.uint8)
    rows[own] = _unpacked(rest, int(own.sum()))
    source = np.maximum.accumulate(np.where(own, np.arange(len(own))[:, None], 0), axis=0)
    return rows[source, np.arange(width)], prefix


def merged(runs: Sequence[tuple[Sequence[bytes], Sequence[int]]], width: int) -> tuple[list[int], list[int]]:
    """All strings of sorted ``runs`` in order: the run of each, and its common prefix with
    the one before. A run is its strings and the common prefix of each with the one before.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    strings = [s for s, _ in runs]
    commons = [c for _, c in runs]
    ends = [len(s) for s in strings]
    now: list[bytes | None] = [s[0] if s else None for s in strings] + [None] * (size - len(runs))
    known = [0] * size  # common prefix with the last winner that passed
    at = [0] * size
    losers = [-1] * size

    def prefix(a: bytes, b: bytes, start: int) -> int:
        differ = int.from_bytes(a[start:], "big") ^ int.from_bytes(b[start:], "big")
        return width - (differ.bit_length() + 7 >> 3)

    winners = [*[-1] * size, *range(size)]
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if now[a] is None or (now[b] is not None and now[b] < now[a]):
            a, b = b, a
        if now[a] is not None and now[b] is not None:
            known[b] = prefix(now[a], now[b], 0)
        winners[node], losers[node] = a, b
    winner = winners[1]
    order, common = [], []
    while now[winner] is not None:
        order.append(winner)
        common.append(known[winner])
        i = at[winner] = at[winner] + 1
        if i < ends[winner]:
            now[winner], known[winner] = strings[winner][i], commons[winner][i]
        else:
            now[winner] = None
        node = winner + size >> 1
        while node:
            other = losers[node]
            b = now[other]
            if b is not None:
                a = now[winner]
                if a is None:
                    losers[node], winner = winner, other
                elif known[winner] < known[other]:
                    losers[node], winner = winner, other
                elif known[winner] == known[other]:
                    start = known[winner]
                    same = prefix(a, b, start)
                    if same < width and b[same] < a[same]:
                        known[winner] = same
                        losers[node], winner = winner, other
                    else:
                        known[other] = same
            node >>= 1
    return order, common


def _splitters(strings: DataFrame, width: int) -> list[bytes]:
    """Strings that cut those of all runs into ranges of about RANGE, from a sample."""
    total = strings.agg(F.sum(F.octet_length("common"))).first()[0] or 0
    ranges = -(-total // RANGE)
    if ranges < 2:
        return []

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, _ = decoded(batch.column("common")[k].as_py(), batch.column("rest")[k].as_py(), width)
                own = rows[len(rows) % STEP // 2 :: STEP]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in own], pa.binary())], ["s"])

    rows = strings.select("common", "rest").mapInArrow(sample, "s binary")
    first = rows.repartitionByRange(ranges, "s").groupBy(F.spark_partition_id().alias("part")).agg(F.min("s").alias("s"))
    return sorted(r.s for r in first.select("s").collect())[1:]


def _pieces(strings: DataFrame, splitters: list[bytes], width: int) -> DataFrame:
    """(part, run, common, rest, ids): each run's strings of each range, front-coded anew."""
    kind = np.dtype(f"S{width}")
    limits = np.array(splitters, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, common = decoded(batch.column("common")[k].as_py(), batch.column("rest")[k].as_py(), width)
                ids = _array(batch, "ids", np.int64, k)
                to = np.searchsorted(np.ascontiguousarray(rows).view(kind).ravel(), limits) if len(rows) else []
                to = [0, *to, len(rows)]
                used = [p for p in range(len(to) - 1) if to[p] < to[p + 1]]
                coded = [front_coded(rows[to[p] : to[p + 1]], common[to[p] : to[p + 1]]) for p in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int64()),
                        pa.array([batch.column("run")[k].as_py()] * len(used), pa.int64()),
                        pa.array([c for c, _ in coded], pa.binary()),
                        pa.array([r for _, r in coded], pa.binary()),
                        pa.array([ids[to[p] : to[p + 1]].tobytes() for p in used], pa.binary()),
                    ],
                    ["part", "run", "common", "rest", "ids"],
                )

    columns = strings.select("run", "common", "rest", "ids")
    return columns.mapInArrow(cut, "part long, run long, common binary, rest binary, ids binary")


class _Range:
    """The strings of one range, merged: places go run by run, as the runs were given."""

    def __init__(self, table: pa.Table, width: int) -> None:
        order = np.argsort(table.column("run").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.runs = table.column("run").to_numpy()
        found = [
            decoded(c, r, width)
            for c, r in zip(table.column("common").to_pylist(), table.column("rest").to_pylist(), strict=True)
        ]
        self.rows = np.concatenate([rows for rows, _ in found])
        self.ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        self.ends = np.cumsum([len(rows) for rows, _ in found])
        parts = []
        for rows, common in found:
            whole = rows.tobytes()
            parts.append(([whole[i : i + width] for i in range(0, len(whole), width)], common.tolist()))
        run, common = merged(parts, width)
        self.common = np.array(common, np.int64)
        by_run = np.argsort(np.array(run, np.int64), kind="stable")
        self.place = np.empty(len(run), np.int64)  # where the k-th of the merged order was
        self.place[by_run] = np.arange(len(run))
        self.first = np.flatnonzero(self.common < width)
        group = np.cumsum(self.common < width) - 1
        self.least = np.minimum.reduceat(self.ids[self.place], self.first)
        self.group = np.empty(len(run), np.int64)
        self.group[self.place] = group

    def slices(self) -> Iterator[tuple[int, slice]]:
        for k, (run, end) in enumerate(zip(self.runs.tolist(), self.ends.tolist(), strict=True)):
            yield run, slice(int(self.ends[k - 1]) if k else 0, end)


# Blocks, and the strings of blocks that share only their anchor.


def _block_rows(b: np.ndarray, start: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each block as it is sorted."""
    x = start + off
    left, right = off.astype(np.int64), n.astype(np.int64) - 1 + SIDE - off
    out = np.zeros((len(x), BLOCK), np.uint8)
    out[:, :GRAM] = b[x[:, None] + np.arange(GRAM)]
    out[:, GRAM], out[:, GRAM + 1] = left, right
    step = np.arange(SIDE)
    inside = step < right[:, None]
    out[:, GRAM + 2 : GRAM + 2 + SIDE][inside] = b[(x[:, None] + GRAM + step)[inside]]
    inside = step < left[:, None]
    out[:, GRAM + 2 + SIDE :][inside] = b[(x[:, None] - 1 - step)[inside]]
    return out


def _strings_of(blocks: np.ndarray, places: range = range(SIDE + 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of the blocks at ``places``: their bytes, the block of each, and its place.

    Places go from 0 to SIDE, by the distance of the anchor: SIDE is right at it.
    """
    text = np.concatenate(
        [blocks[:, GRAM + 2 + SIDE :][:, ::-1], blocks[:, :GRAM], blocks[:, GRAM + 2 : GRAM + 2 + SIDE]], axis=1
    )
    left, right = blocks[:, GRAM].astype(np.int64), blocks[:, GRAM + 1].astype(np.int64)
    place = np.array(places)
    block, k = np.nonzero((place >= SIDE - left[:, None]) & (place <= right[:, None]))
    at = place[k]
    return text[block[:, None], at[:, None] + np.arange(LENGTH)], block, at


def _gone_strings(blocks: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each block a bit at each place whose string some block has with a smaller id.

    Equal strings have equal anchors at equal places, so if there are many blocks they
    are taken place by place.
    """
    bits = np.zeros(len(blocks), np.uint64)
    step = SIDE + 1 if len(blocks) <= _HELD else 1
    for first in range(0, SIDE + 1, step):
        strings, block, at = _strings_of(blocks, range(first, first + step))
        if len(strings):
            _, _, low, which = sorted_distinct(strings, least[block])
            gone = low[which] < least[block]
            np.bitwise_or.at(bits, block[gone], np.uint64(1) << at[gone].astype(np.uint64))
    return bits


def _block_items(runs: DataFrame, shared: DataFrame, groups: int) -> DataFrame:
    """Of each run: its distinct shared blocks as sorted strings, and where they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, off, at = (_array(batch, c, t, k) for c, t in (("n", np.uint8), ("off", np.uint8), ("at", np.int64)))
                b, ids = _text(batch, k, at), _array(batch, "ids", np.int64, k)
                start, doc = _starts(n, at)
                distinct, which = _keys(b, start + off, groups)
                cut, bits = _cuts(distinct, groups), np.zeros(len(distinct), bool)
                for part in batch.column("shared")[k].as_py():
                    low, high = cut[part["part"]], cut[part["part"] + 1]
                    bits[low:high] = np.unpackbits(np.frombuffer(part["shared"], np.uint8), count=high - low)
                own = np.flatnonzero(bits[which])
                rows, common, least, place = sorted_distinct(
                    _block_rows(b, start[own], n[own], off[own]), ids[doc[own]]
                )
                shape = np.empty((len(rows), 2), np.uint8)  # strings, and bytes before the anchor
                shape[place, 0], shape[place, 1] = n[own], off[own]
                coded = front_coded(rows, common)
                columns = [*coded, least, place.astype(np.int32), start[own].astype(np.int64), ids[doc[own]], shape]
                columns = [c if isinstance(c, bytes) else c.tobytes() for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("run")[k].as_py()]), *[pa.array([c], pa.binary()) for c in columns]],
                    ["run", *names],
                )

    names = ["common", "rest", "ids", "item", "start", "own", "shape"]
    joined = runs.select("run", "ids", "at", "text", "n", "off").join(shared, "run")
    return joined.mapInArrow(run, "run long, " + ", ".join(f"{c} binary" for c in names))


#: What a merge says: least ids for a run (kind 0), strings that are still open (kind 1), or
#: which strings of a run's blocks go (kind 2).
_MERGED = ["a", "b", "c", "d", "e", "f", "g"]
_MERGED_SCHEMA = "kind int, run long, part long, " + ", ".join(f"{c} binary" for c in _MERGED)


def _said(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(
        [("kind", pa.int32()), ("run", pa.int64()), ("part", pa.int64()), *[(c, pa.binary()) for c in _MERGED]]
    )
    plain = [[x.tobytes() if isinstance(x, np.ndarray) else x for x in r] + [None] * (len(schema) - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in plain], f.type) for k, f in enumerate(schema)], schema=schema
    )


def _merge_blocks(pieces: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Least ids of all blocks, and which strings go of those that share just their anchor.

    Or these strings, where the blocks of an anchor are in more than one range.
    """

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        own = _Range(table, BLOCK)
        said = [(0, run, part, own.least[own.group[at]]) for run, at in own.slices()]
        shown = own.rows[own.place[own.first]]
        alike = own.common[own.first] >= GRAM  # in the anchor with the block before
        anchor = np.cumsum(~alike)
        cut = np.zeros(len(shown), bool)
        for border in (*splitters[max(0, part - 1) : part], *splitters[part : part + 1]):
            cut |= (shown[:, :GRAM] == np.frombuffer(border, np.uint8)[:GRAM]).all(axis=1)
        many = np.bincount(anchor)[anchor] > 1
        # Whole anchors, up to _HELD blocks of them at a time.
        bits = np.zeros(len(shown), np.uint64)
        some = np.flatnonzero(many & ~cut)
        ends = np.append(np.flatnonzero(np.diff(anchor[some])) + 1, len(some))
        low = 0
        while low < len(some):
            high = ends[max(np.searchsorted(ends, low + _HELD, "right") - 1, np.searchsorted(ends, low, "right"))]
            bits[some[low:high]] = _gone_strings(shown[some[low:high]], own.least[some[low:high]])
            low = high
        # Whose runs have a document with the least id: for the others all strings go.
        open_ = own.ids == own.least[own.group]
        for run, at in own.slices():
            item = np.flatnonzero(open_[at] & (bits[own.group[at]] > 0))
            if len(item):
                said.append((2, run, part, item, bits[own.group[at][item]]))
        if cut.any():
            some = np.flatnonzero(cut)
            strings, block, at = _strings_of(shown[some])
            least = own.least[some]
            rows, common, ids, place = sorted_distinct(strings, least[block])
            number = np.full(len(shown), -1)
            number[some] = np.arange(len(some))
            holder = np.flatnonzero((number[own.group] >= 0) & open_)
            of = np.searchsorted(own.ends, holder, "right")
            item = holder - np.append(0, own.ends)[of]
            said.append((
                1, part, -1, *front_coded(rows, common), ids, place.astype(np.int32),
                np.stack([block, at], axis=1).astype(np.int32), least,
                np.stack([number[own.group[holder]], own.runs[of], item], axis=1).astype(np.int64),
            ))
        return pa.Table.from_batches([_said(said)])

    return pieces.groupBy("part").applyInArrow(merge, _MERGED_SCHEMA)


def _merge_strings(pieces: DataFrame) -> DataFrame:
    """(run, part, least): least ids of all strings, for each run."""

    def merge(table: pa.Table) -> pa.Table:
        own = _Range(table, LENGTH)
        part = table.column("part")[0].as_py()
        said = [(run, part, own.least[own.group[at]].tobytes()) for run, at in own.slices()]
        return pa.Table.from_arrays(
            [pa.array([r[0] for r in said]), pa.array([r[1] for r in said]), pa.array([r[2] for r in said], pa.binary())],
            ["run", "part", "least"],
        )

    return pieces.groupBy("part").applyInArrow(merge, "run long, part long, least binary")


def _open_strings(blocks: DataFrame, least: DataFrame) -> DataFrame:
    """(kind 2, run, part, item, bits): which strings go of blocks with the least id of theirs."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = sorted(batch.column("least")[k].as_py(), key=lambda p: p["part"])
                low = np.concatenate([np.frombuffer(p["least"], np.int64) for p in parts])
                place, where = _array(batch, "d", np.int32, k), _array(batch, "e", np.int32, k).reshape(-1, 2)
                own, holders = _array(batch, "f", np.int64, k), _array(batch, "g", np.int64, k).reshape(-1, 3)
                block, at = where[:, 0], where[:, 1]
                gone = low[place] < own[block]
                bits = np.zeros(len(own), np.uint64)
                np.bitwise_or.at(bits, block[gone], np.uint64(1) << at[gone].astype(np.uint64))
                holders = holders[bits[holders[:, 0]] > 0]
                holders = holders[np.argsort(holders[:, 1], kind="stable")]
                run, begins = np.unique(holders[:, 1], return_index=True)
                cuts = [*begins.tolist(), len(holders)]
                part = batch.column("run")[k].as_py()
                yield _said(
                    [
                        (2, r, part, holders[i:j, 2].copy(), bits[holders[i:j, 0]])
                        for r, i, j in zip(run.tolist(), cuts, cuts[1:], strict=False)
                    ]
                )

    answers = least.groupBy("run").agg(F.collect_list(F.struct("part", "least")).alias("least"))
    joined = blocks.join(answers, "run")
    return joined.mapInArrow(judge, _MERGED_SCHEMA)


def _marks(items: DataFrame, said: DataFrame) -> DataFrame:
    """(run, spans): where the bytes of each run go, as stretches in order."""

    def mark(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next((r for r in rows if r["kind"] == 3), None)
        run = rows[0]["run"]
        if own is None:
            return pa.table({"run": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        item, start, ids = (np.frombuffer(own[c], t) for c, t in (("a", np.int32), ("b", np.int64), ("c", np.int64)))
        shape = np.frombuffer(own["d"], np.uint8).reshape(-1, 2).astype(np.int64)
        # A run's blocks are in order, so those of the ranges are one after another.
        answers = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["part"])
        least = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["a"], np.int64) for r in answers]])
        offset = {r["part"]: k for r, k in zip(answers, np.cumsum([0, *[len(r["a"]) // 8 for r in answers]]), strict=False)}
        bits = np.zeros(len(least), np.uint64)
        for r in rows:
            if r["kind"] == 2:
                bits[offset[r["part"]] + np.frombuffer(r["a"], np.int64)] = np.frombuffer(r["b"], np.uint64)
        gone = ids > least[item]
        begin, end = [start[gone]], [start[gone] + shape[item[gone], 0] - 1 + LENGTH]
        some = np.flatnonzero(~gone & (bits[item] > 0))
        for place in range(SIDE + 1):
            there = some[(bits[item[some]] >> np.uint64(place)) & np.uint64(1) > 0]
            at = start[there] + place - (SIDE - shape[item[there], 1])
            begin.append(at)
            end.append(at + LENGTH)
        # Spans that overlap are of one document; those that touch may not be.
        spans = _united(np.stack([np.concatenate(begin), np.concatenate(end)], axis=1))
        return pa.table({"run": pa.array([run]), "spans": pa.array([spans.tobytes()], pa.binary())})

    occurrences = items.select(
        F.lit(3).alias("kind"), "run", F.lit(0).cast("long").alias("part"),
        F.col("item").alias("a"), F.col("start").alias("b"), F.col("own").alias("c"), F.col("shape").alias("d"),
    )
    rows = occurrences.unionByName(said.select("kind", "run", "part", "a", "b", "c", "d"))
    return rows.groupBy("run").applyInArrow(mark, "run long, spans binary")


def _united(spans: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Overlapping spans as one, and touching ones of one document, whose starts are ``at``."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    if not len(spans):
        return spans
    until = np.maximum.accumulate(spans[:, 1])
    new = spans[1:, 0] >= until[:-1]
    if at is not None:
        doc = np.searchsorted(at, spans[:, 0], "right")
        new = (spans[1:, 0] > until[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(np.append(True, new))
    return np.stack([spans[first, 0], until[np.append(first[1:], len(spans)) - 1]], axis=1)


SPANS = "array<struct<start:long,end:long>>"


def _kept(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans and kept of every document."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, at = _array(batch, "ids", np.int64, k), _array(batch, "at", np.int64, k)
                b = _text(batch, k, at)
                spans = _united(_array(batch, "spans", np.int64, k).reshape(-1, 2), at)
                first = np.searchsorted(spans[:, 0], at)
                edges = np.zeros(len(b) + 1, np.int8)
                edges[spans[:, 0]] += 1
                edges[spans[:, 1]] -= 1
                kept = b[np.cumsum(edges[:-1], dtype=np.int8) == 0]
                gone = np.concatenate([[0], np.cumsum(spans[:, 1] - spans[:, 0])])
                to = at - gone[first]
                for i in range(0, len(ids), 1000):
                    own = range(i, min(i + 1000, len(ids)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if ids[d] == _LAST else int(ids[d]) for d in own], pa.int64()),
                            pa.array(np.diff(at[own.start : own.stop + 1])),
                            pa.array(
                                [
                                    [{"start": s, "end": e} for s, e in (spans[first[d] : first[d + 1]] - at[d]).tolist()]
                                    for d in own
                                ],
                                kind,
                            ),
                            pa.array([kept[to[d] : to[d + 1]].tobytes() for d in own], pa.binary()),
                        ],
                        ["doc_id", "n_bytes", "spans", "kept"],
                    )

    joined = runs.select("run", "ids", "at", "text").join(marks, "run", "left")
    return joined.mapInArrow(cut, f"doc_id long, n_bytes long, spans {SPANS}, kept binary")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (stretches of bytes taken out) and kept (the other bytes)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    runs, _ = written_at(_runs(docs), "text-runs")
    groups = max(1, -(-(runs.agg(F.sum("n_blocks")).first()[0] or 0) // GROUP))
    shared = _shared_anchors(runs, groups)
    items, items_path = written_at(_block_items(runs, shared, groups), "block-runs")
    where, _ = written_at(items.select("run", "item", "start", "own", "shape"), "block-places")
    splitters = _splitters(items, BLOCK)
    said, _ = written_at(_merge_blocks(_pieces(items, splitters, BLOCK), splitters), "merged-blocks")
    remove(spark, items_path)
    blocks = said.filter("kind = 1")
    strings = blocks.select("run", F.col("a").alias("common"), F.col("b").alias("rest"), F.col("c").alias("ids"))
    least, _ = written_at(_merge_strings(_pieces(strings, _splitters(strings, LENGTH), LENGTH)), "merged-strings")
    opened = _open_strings(blocks, least)
    marks, _ = written_at(_marks(where, said.filter("kind <> 1").unionByName(opened)), "marks")
    return _kept(runs, marks)
