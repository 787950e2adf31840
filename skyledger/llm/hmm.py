"""A hidden Markov language model trained by Baum-Welch over all partitions.

Tokens are lower-cased words and one end. Each word belongs to one of CLASSES classes by
its first and last bytes, so an unseen word has a class too; the end is a class of its
own. Latent states emit classes, and a class emits its words in proportion to their
counts (plus one): P(w | state) = P(class | state) (c(w) + 1) / (N_class + V_class + 1).

* Word counts cover all training texts. They stay a table, keyed by a 64-bit hash of the
  word; only the words of the highest counts, COMMON at most, and the totals of classes are sent
  to the tasks. The other words of a text meet their counts in a join.
* An iteration of Baum-Welch reads all training sequences. Tasks add up expected counts
  (states x classes) and Spark sums them over tasks; what reaches the driver has that
  fixed size. For training only, sequences are cut every SEGMENT tokens.
* A score is the exact likelihood of the whole sequence by the scaled forward recursion,
  over many texts at once.

Scores depend on the text alone, so the join goes by a 64-bit hash of the text, and
copies share it. Null and empty texts are just their end; a null id counts as empty
text in the split. Repeated rows get equal results. Without training rows all counts
are zero and the model is its start. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import written
from skyledger.llm.words import _LOWER, Texts, Words, chunks, mixed

STATES = 8
CLASSES = 4096
ITERATIONS = 5
#: Words whose counts are sent to the tasks at most (16 bytes each).
COMMON = 200_000
SEGMENT = 256
END = CLASSES
_GROUP = 1024  # sequences side by side in training
_MERGE = 1 << 20  # distinct words a task gathers before it passes them on


def word_classes(words: Words) -> np.ndarray:
    """The class of each word: a hash of its first two and last two bytes."""
    b, s, e = words.bytes, words.starts, words.ends
    second, before = np.minimum(s + 1, e - 1), np.maximum(e - 2, s)
    key = np.zeros(len(s), np.uint64)
    for place in (s, second, before, e - 1):
        key = key * np.uint64(256) + _LOWER[b[place]]
    return (mixed(key) % np.uint64(CLASSES)).astype(np.uint16)


# Learning ------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, class, c): how often each word occurs in all of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            h, kind, c = map(np.concatenate, zip(*held, strict=True))
            h, first, which = np.unique(h, return_index=True, return_inverse=True)
            return h, kind[first], np.bincount(which, c, len(h)).astype(np.int64)

        def out() -> pa.RecordBatch:
            h, kind, c = merged()
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(c)],
                ["word", "class", "c"],
            )

        for _, texts in chunks(batches):
            words = texts.words()
            h, first, c = np.unique(words.hashes(), return_index=True, return_counts=True)
            held.append((h, word_classes(words)[first], c))
            if sum(len(x[0]) for x in held) > 2 * _MERGE:
                held[:] = [merged()]
                if len(held[0][0]) > _MERGE:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = texts.mapInArrow(run, "word long, class int, c long")
    return rows.groupBy("word").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


@dataclass
class Counts:
    """Totals of a training corpus and the counts of its most frequent words."""

    documents: int
    tokens: int  # words and ends
    types: int
    by_class: np.ndarray  # words in each class
    types_by_class: np.ndarray
    common: np.ndarray  # sorted hashes
    common_counts: np.ndarray

    @property
    def end_known(self) -> int:
        return int(self.documents > 0)


def totals(counts: DataFrame, documents: int) -> Counts:
    rows = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    at = rows.column("class").to_numpy()
    n[at], v[at] = rows.column("n").to_numpy(), rows.column("v").to_numpy()
    # The least count that at most COMMON words reach, from counts of counts by size.
    step = F.floor(F.log2("c") * 8)
    sizes = dict(counts.groupBy(step.alias("s")).agg(F.count("*")).collect())
    least, held = None, 0
    for s in sorted(sizes, reverse=True):
        held += sizes[s]
        if held > COMMON:
            break
        least = s
    words = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if least is not None:
        top = counts.filter(step >= least).select("word", "c").toArrow()
        words = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(words[0])
    return Counts(
        documents, int(n.sum()) + documents, int(v.sum()) + int(documents > 0), n, v,
        words[0][order], words[1][order],
    )


@dataclass
class Model:
    """start[0] begins a text and start[1] a later segment; emit has a row per class."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(share: np.ndarray) -> Model:
        """Sticky states, each with the overall shares of classes, disturbed."""
        draw = np.random.default_rng(20)
        emit = share[:, None] * np.exp(draw.normal(0, 0.5, (len(share), STATES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return Model(np.full((2, STATES), 1 / STATES), move, emit / emit.sum(axis=0))


def class_shares(counts: Counts) -> np.ndarray:
    own = np.append(counts.by_class, counts.documents) + 1.0
    return own / own.sum()


class Expected:
    """Expected counts of starts, moves and emissions, to which sequences are added."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.move32 = model.move.astype(np.float32)
        self.emit32 = model.emit.astype(np.float32)
        self.start = np.zeros((2, STATES))
        self.move = np.zeros((STATES, STATES))
        self.emit = np.zeros_like(model.emit)

    def add(self, tokens: np.ndarray, at: np.ndarray) -> None:
        """Sequences tokens[at[i]:at[i + 1]], none of them empty."""
        size = np.diff(at)
        parts = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[:-1][doc] + k * SEGMENT
        length = np.minimum(SEGMENT, at[1:][doc] - begin)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), _GROUP):
            own = order[i : i + _GROUP]
            self._add(tokens, begin[own], length[own], np.minimum(k[own], 1))

    def _add(self, tokens, begin, length, later) -> None:
        steps, n = int(length[0]), len(begin)
        active = np.searchsorted(-length, -np.arange(steps), "left")  # longer than t
        place = np.minimum(begin + np.arange(steps)[:, None], len(tokens) - 1)
        kinds = tokens[place]
        emit = self.emit32[kinds]
        alpha = np.empty((steps, n, STATES), np.float32)
        scale = np.empty((steps, n, 1), np.float32)
        now = self.model.start.astype(np.float32)[later] * emit[0]
        for t in range(steps):
            m = active[t]
            if t:
                now = (alpha[t - 1, :m] @ self.move32) * emit[t, :m]
            scale[t, :m] = now.sum(axis=1, keepdims=True)
            alpha[t, :m] = now / scale[t, :m]
        beta = np.ones((n, STATES), np.float32)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            if t + 1 < steps:
                ahead = active[t + 1]
                after = emit[t + 1, :ahead] * beta[:ahead] / scale[t + 1, :ahead]
                self.move += (alpha[t, :ahead].T @ after) * self.model.move
                beta[:ahead] = after @ self.move32.T
            alpha[t, :m] *= beta[:m]  # now the probability of each state
        for which in (0, 1):
            self.start[which] += alpha[0, later == which].sum(axis=0)
        there = np.arange(n) < active[:, None]
        seen, kinds = alpha[there], kinds[there]
        for s in range(STATES):
            self.emit[:, s] += np.bincount(kinds, seen[:, s], len(self.emit))

    def rows(self) -> np.ndarray:
        return np.concatenate([self.start, self.move, self.emit])


def improved(model: Model, sequences: DataFrame, share: np.ndarray) -> Model:
    """One iteration of Baum-Welch over all ``sequences`` (classes: uint16 as binary)."""
    names = [f"s{k}" for k in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = Expected(model)
        for batch in batches:
            expected.add(*_tokens(batch))
        rows = expected.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(rows), dtype=np.int32)), *map(pa.array, rows.T.copy())],
            ["place", *names],
        )

    schema = "place int, " + ", ".join(f"{n} double" for n in names)
    rows = sequences.select("classes").mapInArrow(run, schema).groupBy("place").agg(
        *[F.sum(n).alias(n) for n in names]
    )
    table = rows.toArrow()
    sums = np.zeros((2 + STATES + len(share), STATES))
    sums[table.column("place").to_numpy()] = np.stack([table.column(n).to_numpy() for n in names], axis=1)
    start, move, emit = sums[:2] + 0.1, sums[2 : 2 + STATES] + 0.1, sums[2 + STATES :]
    emit = emit + share[:, None]  # one token's worth of the overall shares in each state
    return Model(
        start / start.sum(axis=1, keepdims=True),
        move / move.sum(axis=1, keepdims=True),
        emit / emit.sum(axis=0),
    )


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("classes").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data.view(np.uint16) if not at[0] % 2 else data.copy().view(np.uint16), (at - at[0]) // 2


# Scoring -------------------------------------------------------------------------------


def log_likelihoods(model: Model, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 of the probability of each sequence of classes, none of them empty."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, length = at[:-1][order], size[order]
    total = np.zeros(len(size))
    if not len(size):
        return total
    active = np.searchsorted(-length, -np.arange(int(length[0])), "left")
    alpha = np.empty((0, STATES))
    for t, m in enumerate(active):
        emit = model.emit[tokens[begin[:m] + t]]
        alpha = (alpha[:m] @ model.move if t else model.start[:1]) * emit
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        total[:m] += np.log10(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


def _sequences(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, key, and the classes of all tokens as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = texts.words()
            kinds = word_classes(words)
            own = [
                np.append(kinds[a:b], np.uint16(END)).tobytes()
                for a, b in zip(words.at[:-1], words.at[1:], strict=True)
            ]
            names = ["doc_id", "held_out", "key"]
            yield pa.RecordBatch.from_arrays(
                [*map(part.column, names), pa.array(own, pa.binary())], [*names, "classes"]
            )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, key long, classes binary")


def _class_scores(sequences: DataFrame, model: Model, within: np.ndarray) -> DataFrame:
    """Adds ``class_score``: classes by the model, and the share of a class's word slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, at = _tokens(batch)
            score = log_likelihoods(model, tokens, at)
            sums = np.concatenate([[0.0], np.cumsum(within[tokens])])
            score += sums[at[1:]] - sums[at[:-1]]
            names = ["doc_id", "held_out", "key"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(np.diff(at)), pa.array(score)],
                [*names, "n_tokens", "class_score"],
            )

    return sequences.mapInArrow(
        run, "doc_id long, held_out boolean, key long, n_tokens long, class_score double"
    )


def _word_sums(docs: DataFrame, counts: DataFrame, known: Counts) -> DataFrame:
    """(key, n_known, log_counts): known words of a text, and the sum of log10(c + 1)."""
    common, log_count = known.common, np.log10(known.common_counts + 1.0)

    def per_text(texts: Texts, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = texts.words()
        h = words.hashes()
        text = np.repeat(np.arange(len(keys)), np.diff(words.at))
        place = np.searchsorted(common, h)
        place[place == len(common)] = 0
        is_common = common[place] == h if len(common) else np.zeros(len(h), bool)
        sums = np.bincount(text[is_common], log_count[place[is_common]], len(keys))
        known_words = np.bincount(text[is_common], minlength=len(keys))
        rare, owner = h[~is_common], text[~is_common]
        order = np.lexsort((rare, owner))
        rare, owner = rare[order], owner[order]
        new = np.ones(len(rare), bool)
        new[1:] = (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(rare)))
        # A row for the text itself, whose word is none; then one for each rare word.
        nulls = np.ones(len(begin), bool)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([keys, keys[owner[begin]]])),
                pa.array(np.concatenate([mixed(keys.view(np.uint64)), rare[begin]]).view(np.int64)),
                pa.array(np.concatenate([known_words, times])),
                pa.array(np.concatenate([sums, np.zeros(len(begin))]), mask=np.concatenate([np.zeros(len(keys), bool), nulls])),
            ],
            ["key", "word", "n", "sum"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield from per_text(texts, part.column("key").to_numpy(zero_copy_only=False))

    tokens = docs.select("key", "text").mapInArrow(run, "key long, word long, n long, sum double")
    own = F.col("sum").isNotNull()
    found = F.col("c").isNotNull()
    joined = tokens.join(counts.select("word", "c"), "word", "left")
    # Copies of a text were counted together, as often as there are.
    sums = joined.groupBy("key").agg(
        F.sum(own.cast("long")).alias("copies"),
        F.sum(F.when(own | found, F.col("n"))).alias("n_known"),
        F.sum(
            F.when(own, F.col("sum")).when(found, F.col("n") * F.log10(F.col("c") + 1))
        ).alias("log_counts"),
    )
    return sums.select(
        "key",
        F.expr("n_known div copies").alias("n_known"),
        (F.col("log_counts") / F.col("copies")).alias("log_counts"),
    )


def train_and_score(
    docs: DataFrame,
    held_out: Column,
    id_column: str = "doc_id",
    text: str = "text",
    iterations: int = ITERATIONS,
) -> DataFrame:
    """Scores every row by a model of the rows that are not ``held_out``."""
    content = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        held_out.alias("held_out"),
        F.xxhash64(content).alias("key"),
        content.alias("text"),
    )
    training = docs.filter(~F.col("held_out"))
    counts = written(word_counts(training.select("text")), "word-counts")
    sequences = written(_sequences(docs), "class-sequences")
    own = sequences.filter(~F.col("held_out"))
    known = totals(counts, own.count())
    share = class_shares(known)
    model = Model.first(share)
    for _ in range(iterations):
        model = improved(model, own, share)
    within = np.append(-np.log10(known.by_class + known.types_by_class + 1.0), 0.0)
    scored = written(_class_scores(sequences, model, within), "class-scores")
    words = written(_word_sums(docs, counts, known), "word-sums")
    base_total = float(np.log10(known.tokens + known.types + 1.0))
    end = float(np.log10(known.documents + 1.0))
    return scored.join(words, "key").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known.end_known).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + end - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("class_score") + F.col("log_counts")).alias("score"),
    )
