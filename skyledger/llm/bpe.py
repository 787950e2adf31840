"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap.

Texts are cut into pre-tokens as by the vocabulary's pattern (contractions, runs of
letters, numbers and other marks with one space before, white space). The first tier
looks each up in a minimal perfect hash of the vocabulary: two array reads, then the
whole 64-bit hash and the length are compared. The second tier merges the bytes of a
pre-token that is no token itself: linked bytes, and a heap of neighbouring pairs by
rank and place. Results of the second tier are kept for the next texts of a worker by
their bytes, up to ``KEEP`` of them: of two halves the older one goes when the newer is full.
Where only the ids matter, as in packing, those of up to ``LONGEST`` bytes are merged together
instead, a merge of each in a round over arrays, with the same ids.

Null and empty texts have no ids; other columns are kept as they are; equal rows get
equal ids; an empty table gives an empty result. Ids of one text are one row.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator, Mapping
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyledger.llm.words import Texts, chunks, mixed, span_hashes

#: Merged pre-tokens a worker keeps (about 180 bytes each); more only cost time.
KEEP = 400_000
#: Longest pre-token, in bytes, that is merged together with others.
LONGEST = 32

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
# White space of the pattern, and the endings after an apostrophe.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
# The first and last of the letters and numbers that Unicode 16.0 added. The
# tokenizer's library knows these, an older unicodedata does not.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array(
        [kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8
    )
    for ranges, kind in ((LETTERS_16, _LETTER), (NUMBERS_16, _NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[list(WHITE_SPACE)] = _SPACE
    return table


def pre_tokens(texts: Texts, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens in bytes, and where those of each text begin."""
    points = np.frombuffer(texts.bytes.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(texts.at), np.int64)
    width = np.ones(n, np.int64)
    for least in (0x80, 0x800, 0x10000):
        width += points >= least
    at = np.concatenate([[0], np.cumsum(width)])
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(at, texts.at)] = True
    kind = classes[points]
    run = first.copy()  # starts of runs of one class
    run[1:-1] |= kind[1:] != kind[:-1]
    run[-1] = True
    start = run.copy()
    begins = np.flatnonzero(run)
    begin, end = begins[:-1], begins[1:]
    # The last of some white space stands alone, and a plain space joins what follows.
    blank = kind[begin] == _SPACE
    inner = end[blank & ~first[end]]
    start[inner - 1] = True
    joins = inner[points[inner - 1] == 0x20]
    start[joins] = False
    # An apostrophe that begins a pre-token and has one of the endings after it.
    mark = begin[(points[begin] == 0x27) & (end - begin == 1) & start[begin] & ~first[end]]
    for ending in ENDINGS:
        k = len(ending)
        fits = mark[mark + k < n]
        for j, c in enumerate(ending, 1):
            fits = fits[(points[fits + j] == ord(c)) & ~first[fits + j]]
        start[fits + 1] = False
        after = fits + k + 1
        inside = after[after < n]
        start[inside[~first[inside] & (kind[inside] == _LETTER)]] = True
    places = np.flatnonzero(start[:n])
    bounds = np.concatenate([at[places], [at[-1]]])
    return bounds[:-1], bounds[1:], np.searchsorted(bounds[:-1], texts.at)


class PerfectHash:
    """Slots 0 to n - 1 for n different 64-bit hashes, by hash and displace."""

    def __init__(self, keys: np.ndarray) -> None:
        n = len(keys)
        self.n, self.buckets = np.uint64(n), np.uint64(max(1, n // 2))
        shift = np.zeros(int(self.buckets), np.int64)
        bucket = (keys % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(shift))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        free = np.ones(n, bool)
        seeds = np.arange(1, 65, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            own = keys[order[begins[b] : begins[b + 1]]]
            if len(own) < 2:
                break
            base = np.uint64(0)
            while shift[b] == 0:
                slots = self._slots(own[None, :], (base + seeds)[:, None])
                good = free[slots].all(axis=1)
                for i in np.flatnonzero(good):
                    if len(set(slots[i].tolist())) == len(own):
                        shift[b] = int(base + seeds[i])
                        free[slots[i]] = False
                        break
                base += np.uint64(64)
        left = np.flatnonzero(free)
        single = np.flatnonzero(sizes == 1)
        shift[single] = -1 - left[: len(single)]  # the slot itself
        self.shift = shift

    def _slots(self, keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mixed(keys ^ (seeds * np.uint64(0x9E3779B97F4A7C15))) % self.n).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that was given; any slot for another."""
        shift = self.shift[(keys % self.buckets).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(keys, shift.astype(np.uint64)))


class Merges:
    """Ranks of byte strings, and a table of those of two bytes."""

    def __init__(self, ranks: Mapping[bytes, int]) -> None:
        self.ranks = ranks
        self.two: list[int | None] = [None] * (1 << 16)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank

    def merged(self, piece: bytes) -> list[int]:
        """Ids of ``piece`` after all merges, lowest rank first, the leftmost of equals."""
        n, rank_of, two = len(piece), self.ranks.get, self.two
        after = list(range(1, n + 1))  # where the part that begins at i ends
        before = list(range(-1, n - 1))  # where the part before it begins
        # A heap entry is one number: rank, begin and end of a pair of neighbours.
        bits = n.bit_length()
        last, above = (1 << bits) - 1, 2 * bits
        heap = [
            rank << above | i << bits | i + 2
            for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False))
            if (rank := two[a << 8 | b]) is not None
        ]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, end = entry >> bits & last, entry & last
            middle = after[i]
            # A pair that has changed since is passed over; its new form is in the heap.
            if middle >= end or after[middle] != end:
                continue
            after[i], after[middle] = end, n
            if end < n:
                before[end] = i
                rank = rank_of(piece[i : after[end]])
                if rank is not None:
                    heappush(heap, rank << above | i << bits | after[end])
            if i:
                h = before[i]
                rank = rank_of(piece[h:end])
                if rank is not None:
                    heappush(heap, rank << above | h << bits | end)
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(self.ranks[piece[i:end]])
            i = end
        return ids


class Pairs:
    """The rank of each two tokens that make a third, in a table with open addressing."""

    NONE = np.int32(np.iinfo(np.int32).max)
    _EMPTY = np.uint64(np.iinfo(np.uint64).max)

    def __init__(self, ranks: Mapping[bytes, int]) -> None:
        self.width = np.uint64(max(ranks.values()) + 1)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a * int(self.width) + b)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self._EMPTY)
        self.values = np.full(1 << bits, self.NONE)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == self._EMPTY
            self.keys[slot[free]] = keys[free]  # of several for one slot, one is put there
            there = self.keys[slot] == keys
            self.values[slot[there]] = values[there]
            keys, values, slot = keys[~there], values[~there], (slot[~there] + 1) & self.last
        self.byte = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int32)
        self.two = np.array(
            [ranks.get(bytes([x, y]), self.NONE) for x in range(256) for y in range(256)], np.int32
        )

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each token of ``a`` joined with that of ``b``; NONE if that is no token."""
        keys = a.astype(np.uint64) * self.width + b.astype(np.uint64)
        slot = self._slots(keys)
        there = self.keys[slot]
        same = there == keys
        out = np.where(same, self.values[slot], self.NONE)
        left = np.flatnonzero(~same & (there != self._EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            there = self.keys[slot[left]]
            same = there == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (there != self._EMPTY)]
        return out

    def merged(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces one after another, and how many each has: as ``Merges.merged``.

        Rounds from the longest to one part: those with so many parts are rows of one array, of which each
        loses one by its merge of lowest rank, the leftmost of equals, or is done.
        """
        size, count = ends - starts, np.zeros(len(starts), np.int64)
        longest = int(size.max(initial=0))
        order = np.argsort(size, kind="stable")
        at = np.searchsorted(size[order], np.arange(longest + 2))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        own, ids = np.zeros(0, np.int64), np.zeros((0, longest), np.int32)
        ranks = np.zeros((0, max(0, longest - 1)), np.int32)
        for k in range(longest, 0, -1):
            new = order[at[k] : at[k + 1]]
            if len(new):
                raw = b[starts[new][:, None] + np.arange(k)]
                own, ids = np.concatenate([own, new]), np.concatenate([ids, self.byte[raw]])
                ranks = np.concatenate([ranks, self.two[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]])
            if k == 1:
                done.append((own, ids))
                break
            row = np.arange(len(own))
            j = ranks.argmin(axis=1)
            least = ranks[row, j]
            ended = least == self.NONE
            if ended.any():
                done.append((own[ended], ids[ended]))
                own, ids, ranks, j, least = (x[~ended] for x in (own, ids, ranks, j, least))
                row = row[: len(own)]
            ids[row, j] = least
            left = np.ones(ids.shape, bool)
            left[row, j + 1] = False
            ids = ids[left].reshape(len(own), k - 1)
            left = np.ones(ranks.shape, bool)
            left[row, j] = False
            ranks = ranks[left].reshape(len(own), k - 2)
            for rows, i in ((row[j > 0], j[j > 0] - 1), (row[j < k - 2], j[j < k - 2])):
                ranks[rows, i] = self.ranks(ids[rows, i], ids[rows, i + 1])
        for own, ids in done:
            count[own] = ids.shape[1]
        to = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for own, ids in done:
            flat[to[own][:, None] + np.arange(ids.shape[1])] = ids
        if (flat < 0).any():
            raise KeyError("a byte that is no token")
        return flat, count


#: Pairs by vocabulary, for all tasks of one worker.
_PAIRS: dict[int, Pairs] = {}
#: Merged pre-tokens by vocabulary, newer and older ones, for all tasks of one worker.
_KNOWN: dict[int, list[dict[bytes, bytes]]] = {}


class Vocabulary:
    """Ranks of byte strings. Built on the driver from its file, sent to the tasks."""

    def __init__(self, ranks: Mapping[bytes, int]) -> None:
        self.ranks = dict(ranks)
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.ids = np.array([self.ranks[t] for t in tokens], np.int32)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        ends = np.cumsum(self.lengths)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = ends - self.lengths
        hashes = span_hashes(self.bytes, self.starts, ends)
        self.hash = PerfectHash(hashes)
        slots = self.hash.slots(hashes)
        if len(np.unique(slots)) != len(tokens):
            raise ValueError("two tokens share a hash")
        self.token_at = np.empty(len(tokens), np.int64)
        self.token_at[slots] = np.arange(len(tokens))
        self.hashes = hashes
        self.row_of = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.row_of[self.ids] = np.arange(len(tokens))
        self.classes = character_classes()
        self.merges = Merges(self.ranks)
        self.name = int(mixed(np.bitwise_xor.reduce(hashes * (self.ids + 1).astype(np.uint64), keepdims=True))[0])

    def whole(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The id of each pre-token that is a token itself, else -1."""
        row = self.token_at[self.hash.slots(hashes)]
        same = (self.hashes[row] == hashes) & (self.lengths[row] == lengths)
        return np.where(same, self.ids[row], -1)

    def encode(self, texts: Texts, together: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each begin.

        ``together``: short pre-tokens that are no tokens are merged all at once, not each by a heap.
        """
        starts, ends, at = pre_tokens(texts, self.classes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts.at), np.int64)
        hashes = span_hashes(texts.bytes, starts, ends)
        found = self.whole(hashes, ends - starts)
        missed = np.flatnonzero(found < 0)
        _, example, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
        merged = self._merged_together if together else self._merged_all
        flat, sizes = merged(texts, starts[missed[example]], ends[missed[example]])
        count = np.ones(len(starts), np.int64)
        count[missed] = sizes[which]
        to = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(to[-1], np.int32)
        ids[to[:-1]] = found
        if len(missed):
            many = count[missed]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin = (np.cumsum(sizes) - sizes)[which]
            ids[np.repeat(to[missed], many) + step] = flat[np.repeat(begin, many) + step]
        return ids, to[at]

    def _merged_together(self, texts, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has; long ones by a heap."""
        if self.name not in _PAIRS:
            _PAIRS[self.name] = Pairs(self.ranks)
        long = ends - starts > LONGEST
        if not long.any():
            return _PAIRS[self.name].merged(texts.bytes, starts, ends)
        sizes = np.empty(len(starts), np.int64)
        some, sizes[~long] = _PAIRS[self.name].merged(texts.bytes, starts[~long], ends[~long])
        others, sizes[long] = self._merged_all(texts, starts[long], ends[long])
        flat = np.empty(len(some) + len(others), np.int32)
        of_long = np.repeat(long, sizes)
        flat[~of_long], flat[of_long] = some, others
        return flat, sizes

    def _merged_all(self, texts, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has; those met before are found by their bytes."""
        generations = _KNOWN.setdefault(self.name, [{}, {}])
        new, old = generations
        if len(new) > KEEP // 2:
            new, old = generations[:] = {}, new
        merged, out = self.merges.merged, []
        whole = texts.bytes.tobytes()
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            piece = whole[start:end]
            ids = new.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = array("i", merged(piece)).tobytes()
                new[piece] = ids
            out.append(ids)
        sizes = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), np.int32), sizes

    def decode(self, ids: np.ndarray, at: np.ndarray) -> Texts:
        """The bytes of each text's ids."""
        row = self.row_of[ids]
        size = self.lengths[row]
        to = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(to[-1]) - np.repeat(to[:-1], size)
        return Texts(self.bytes[np.repeat(self.starts[row], size) + step], to[at])


@lru_cache(4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return Vocabulary({base64.b64decode(p[0]): int(p[1]) for p in pairs if p})


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))


def _contents(texts: Texts) -> pa.Array:
    at = pa.array(texts.at, pa.int32())
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(at) - 1, [None, at.buffers()[1], pa.py_buffer(texts.bytes)]
    )


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with an array of token ids in the place of the text.

    ``decoded`` names a column for the bytes that these ids stand for, found from the
    ids in the same task.
    """
    new = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {})
    names = [f.name for f in docs.schema.fields if f.name != text and f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, text):
            values, at = vocabulary.encode(texts)
            columns = [*map(part.column, names), _lists(values, at)]
            if decoded:
                columns.append(_contents(vocabulary.decode(values, at)))
            yield pa.RecordBatch.from_arrays(columns, [*names, *new])

    schema = docs.select(*names).schema
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return docs.select(*names, text).mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that its ids stand for; null for null ids."""
    kept = [f.name for f in docs.schema.fields if f.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            at = np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)))])
            values = column.flatten().to_numpy(zero_copy_only=False)
            found = vocabulary.decode(values, at.astype(np.int64))
            none = column.is_null().to_numpy(zero_copy_only=False)
            content = [
                None if none[i] else found.bytes[found.at[i] : found.at[i + 1]].tobytes()
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(content, pa.binary())], [*kept, to]
            )

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add(to, T.BinaryType()))
