"""Words and shingles of Arrow text batches, as numpy arrays.

A word is a run of bytes other than space and 0x09 to 0x0D. Hashes are 64-bit, so equal
words have equal hashes in every task, and different words differ but for one pair in
2^64: up to SHORT bytes a polynomial over a fixed random table of byte values, mixed at
the end; beyond that BLAKE2b, as long words of few letters can be made for which every
polynomial modulo 2^64 is equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as numpy arrays at a time; one longer text is taken whole.
CHUNK = 1 << 19
#: Longest span, in bytes, that is hashed by a polynomial.
SHORT = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * 2 + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

SHINGLE = 5
_SHINGLE_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * 2 + 1


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts(NamedTuple):
    """Bytes of some texts, one after another; text i is bytes[at[i]:at[i + 1]]."""

    bytes: np.ndarray
    at: np.ndarray

    def words(self, of: np.ndarray = ~_SPACE) -> Words:
        """Runs of the bytes for which ``of`` (an entry for each value) is true."""
        b, at = self.bytes, self.at
        word = of[b]
        starts, ends = word.copy(), word.copy()
        starts[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        full = at[1:] > at[:-1]
        first, last = at[:-1][full], at[1:][full] - 1
        starts[first] = word[first]
        ends[last] = word[last]
        begin = np.flatnonzero(starts)
        return Words(b, begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, at))


class Words(NamedTuple):
    """Words of some texts; those of text i are at[i] to at[i + 1]."""

    bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    def hashes(self, lower: bool = True) -> np.ndarray:
        return span_hashes(self.bytes, self.starts, self.ends, lower)


def span_hashes(
    b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A hash for each span of bytes; spans are in order and do not overlap."""
    values = _VALUES[_LOWER] if lower else _VALUES
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        base, to = starts[i], ends[j - 1]
        sums = np.zeros(to - base + 1, np.uint64)
        np.cumsum(values[b[base:to]] * _powers(_BASE, to - base), out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mixed((sums[e] - sums[s]) * _powers(_INVERSE, to - base)[s])
        i = j
    for i in np.flatnonzero(ends - starts > SHORT):
        own = b[starts[i] : ends[i]]
        own = (_LOWER[own] if lower else own).tobytes()
        out[i] = int.from_bytes(blake2b(own, digest_size=8).digest(), "little")
    return out


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of five words in text order, and where each text's begin.

    A text of one to four words has one shingle, of all its words.
    """
    n = np.diff(at)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    to = np.concatenate([[0], np.cumsum(count)])
    padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    rolled = np.zeros(len(words), np.uint64)
    for k, weight in enumerate(_SHINGLE_WEIGHTS):
        rolled += padded[k : k + len(words)] * weight
    text = np.repeat(np.arange(len(n)), count)
    h = mixed(rolled[at[:-1][text] + np.arange(to[-1]) - to[:-1][text]])
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        own = words[at[i] : at[i + 1]]
        h[to[i] : to[i + 1]] = mixed((own * _SHINGLE_WEIGHTS[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))
    return h, to


def texts_of(column: pa.Array) -> Texts:
    """A null text is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(b[at[0] : at[-1]], at - at[0])


def chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about ``size`` bytes of text, or with one longer text."""
    for batch in batches:
        all_texts = texts_of(batch.column(text))
        i = 0
        while i < batch.num_rows:
            at = all_texts.at
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), Texts(all_texts.bytes[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j
