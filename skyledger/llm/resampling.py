"""Documents drawn towards a target distribution, by importance weights.

Words are runs of letters a-z (A-Z lowered), digits and bytes of other characters; a
feature is a run of 1 to ``runs`` words joined by one space, and its bucket the CRC-32
of its bytes modulo BUCKETS. Counts of buckets over all documents and over the target
give each bucket a gain, in thousandths of a logarithm; an array of all gains is sent to
the tasks and scores a text by its buckets. A document's weight is the floored mean of its
gains, and its score that weight plus Gumbel noise from a hash of its id, so the highest
scores are a draw without replacement.

The draw's cutoff is found by weighted median-of-medians selection. In each round every
partition gives the median and number of its remaining keys (one row); the median of
these, weighted by the numbers, has at least a quarter of all remaining keys on each side.
Counting them tells which side holds the cutoff, and the other is discarded, until the
exact key is met. Remaining keys are written anew when half are gone, so all rounds
together read a few times the keys, and no sort of all documents is needed. Only the
winners are sorted, in ranges with a prefix sum of their sizes.

Null and empty texts have no features: weight 0, never drawn as they have no words. A
null id is an empty text in the noise and comes last in ties. Rows with equal id and
score are interchangeable: which of them is drawn last is open, their number is not. An
empty table gives an empty result, an empty target gains against T = 0. Only the named
columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyledger.llm.store import written
from skyledger.llm.words import _LOWER, Texts, chunks

BUCKETS = 10_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Features up to this many bytes are checksummed together, byte by byte.
_SHORT = 48


def _table() -> np.ndarray:
    """The CRC-32 of one byte, by the reversed polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _table()


def checksums(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    from_, length = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    n = np.searchsorted(-length, -np.arange(1, _SHORT + 1), "right")  # spans with a j-th byte
    for j, k in enumerate(n):
        if not k:
            break
        crc[:k] = _CRC[(crc[:k] ^ b[from_[:k] + j]) & np.uint32(255)] ^ (crc[:k] >> np.uint32(8))
    crc = ~crc
    for i in range(int(np.searchsorted(-length, -_SHORT, "left"))):
        crc[i] = zlib.crc32(b[from_[i] : from_[i] + length[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: Texts, runs: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, where those of each text begin, and words by text."""
    words = texts.words(_WORD)
    low = _LOWER[texts.bytes]
    n_words = np.diff(words.at)
    if runs == 1:
        found = checksums(low, words.starts, words.ends) % np.uint32(BUCKETS)
        return found.astype(np.int64), words.at, n_words
    # Words with one space between them: a feature is then one stretch of bytes.
    size = words.ends - words.starts
    to = np.cumsum(size + 1) - 1
    begin = to - size
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    joined = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    joined[np.repeat(begin, size) + step] = low[np.repeat(words.starts, size) + step]
    text = np.repeat(np.arange(len(n_words)), n_words)
    buckets, owners = [], []
    for k in range(1, runs + 1):
        first = np.arange(len(size) - k + 1)
        first = first[text[first] == text[first + k - 1]] if len(first) else first
        buckets.append(checksums(joined, begin[first], to[first + k - 1]) % np.uint32(BUCKETS))
        owners.append(text[first])
    bucket, owner = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(n_words) + 1)), n_words


def bucket_counts(texts: DataFrame, text: str = "text", runs: int = 1) -> np.ndarray:
    """How many features of all rows are in each bucket; a task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for _, part in chunks(batches):
            sums += np.bincount(features(part, runs)[0], minlength=BUCKETS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bucket", "n"])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long")
    table = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of target share over source share, each bucket once more."""
    all_s, all_t = int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (all_s + BUCKETS)) / ((s + 1) * (all_t + BUCKETS))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def scored(
    docs: DataFrame, gain: np.ndarray, salt: str, id_column: str = "doc_id", text: str = "text", runs: int = 1
) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            bucket, at, n_words = features(texts, runs)
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            n = np.diff(at)
            weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)
            columns = [part.column("doc_id"), n_words.astype(np.int64), n, weight]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise.cast("long"))


#: Sorts a null id after all others: no id of a row is larger.
_LAST = (1 << 63) - 1


def _median(score: np.ndarray, last: np.ndarray) -> tuple[int, int]:
    """The middle key of some in the order of score from the highest, then of id."""
    middle = (len(score) - 1) // 2
    s = np.partition(-score, middle)[middle]
    ties = last[-score == s]
    place = middle - int((-score < s).sum())
    return int(-s), int(np.partition(ties, place)[place])


def cutoff(keys: DataFrame, wanted: int) -> tuple[int, int] | None:
    """The key (score, id) of the ``wanted``-th row by score descending, id ascending.

    ``keys`` has score and last (the id, nulls as the largest number).
    """
    total = keys.count()
    if not 0 < wanted <= total:
        return None
    while True:

        def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [batch for batch in batches if batch.num_rows]
            if parts:
                table = pa.Table.from_batches(parts)
                score, last = (table.column(c).to_numpy() for c in ("score", "last"))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("score", "last", "n"), (*_median(score, last), len(score)), strict=True))],
                    pa.schema([("score", pa.int64()), ("last", pa.int64()), ("n", pa.int64())]),
                )

        found = keys.select("score", "last").mapInArrow(medians, "score long, last long, n long").toArrow()
        found = found.append_column("down", pc.negate(found.column("score")))
        found = found.sort_by([("down", "ascending"), ("last", "ascending")])
        until = np.cumsum(found.column("n").to_numpy())
        middle = int(np.searchsorted(2 * until, until[-1]))
        score, last = (found.column(c)[middle].as_py() for c in ("score", "last"))
        before = (F.col("score") > score) | ((F.col("score") == score) & (F.col("last") < last))
        same = (F.col("score") == score) & (F.col("last") == last)
        counts = keys.agg(F.count_if(before).alias("before"), F.count_if(same).alias("same")).first()
        if wanted <= counts.before:
            keys, left = keys.filter(before), counts.before
        elif wanted <= counts.before + counts.same:
            return score, last
        else:
            wanted -= counts.before + counts.same
            keys, left = keys.filter(~before & ~same), total - counts.before - counts.same
        keys, total = written(keys, "remaining-keys"), left


def draw(scores: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, ... of the drawn rows, null for the others.

    Drawn are the highest scores, ``percent`` of the rows with ``least_words`` words.
    """
    spread = F.rand(2024)  # parts equal keys; written, so every reading has the same
    last = F.coalesce("doc_id", F.lit(_LAST))
    rows = written(scores.withColumns({"last": last, "spread": spread}), "scores")
    able = F.col("n_words") >= least_words
    keys = written(rows.filter(able).select("score", "last"), "keys")
    wanted = percent * keys.count() // 100
    at = cutoff(keys, wanted)
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if at is None:
        return rows.select(*out, none)
    score, last_id = at
    wins = able & ((F.col("score") > score) | ((F.col("score") == score) & (F.col("last") <= last_id)))
    order = [F.desc("score"), F.asc("last"), F.asc("spread")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    winners = written(
        rows.filter(wins).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "winners"
    )
    # One row for each partition: the window over them is as small as their number.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = winners.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) + F.col("offset")
    ranked = winners.join(offsets, "part").select(*out, place.cast("long").alias("rank"))
    # Rows with the key of the cutoff may be more than are wanted.
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(rows.filter(~wins).select(*out, none))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int,
    least_words: int,
    salt: str,
    id_column: str = "doc_id",
    text: str = "text",
    runs: int = 1,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text, runs), bucket_counts(target, text, runs))
    return draw(scored(docs, gain, salt, id_column, text, runs), percent, least_words)
