"""Text quality from random-index word vectors and a small network.

A word has two units: its hash, and its form (counts of upper case, lower case, digits,
marks and other bytes, in steps). Both live in one table of UNITS rows, so the table is
as large for any vocabulary. Each unit has a sparse ternary index vector; the vector of
a unit is the sum of the index vectors of units within WINDOW words around it, over all
documents, labelled or not. A document is pooled to the mean and spread of its units'
vectors, with its length, its share of different words and of words like the one
before.

A two-layer network in numpy is fitted on the pooled vectors of at most TRAIN_ROWS
labelled documents (the ones with the least hash of their id) and its temperature on a
fifth of them that was not fitted. All other sums cover all rows.

Null and empty texts have no units and are scored from zero vectors; repeated rows get
equal scores; labels that contradict each other for one id are averaged; without any
label, or with one kind of label only, the score is the share of label 1, or 0.5. Of rows
with one id and different texts the one of least pooled vector (as bytes) is learnt from.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import written
from skyledger.llm.words import Texts, chunks, mixed

DIMENSIONS = 32
NONZERO = 6
WORD_UNITS = 1 << 14
FORM_UNITS = 1 << 10
UNITS = WORD_UNITS + FORM_UNITS
WINDOW = 2
FEATURES = 4 * DIMENSIONS + 4
TRAIN_ROWS = 20_000
HIDDEN = 32

_KINDS = np.full(256, 4, np.uint8)  # other
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58] = 0, 1, 2
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_STEPS = np.minimum(np.array([0, 1, 2, 3, 3, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 5, 6], np.uint64), np.uint64(6))


def index_vectors() -> np.ndarray:
    draw = np.random.default_rng(12)
    out = np.zeros((UNITS, DIMENSIONS), np.float32)
    for row in out:
        row[draw.choice(DIMENSIONS, NONZERO, replace=False)] = draw.choice([-1, 1], NONZERO)
    return out


def units(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash and form unit of each word, and where the words of each text begin."""
    words = texts.words()
    word = (words.hashes(lower=False) % np.uint64(WORD_UNITS)).astype(np.int32)
    kinds = _KINDS[texts.bytes]
    form = np.zeros(len(word), np.uint64)
    for kind in range(5):
        sums = np.concatenate([[0], np.cumsum(kinds == kind)])
        count = sums[words.ends] - sums[words.starts]
        form = form * np.uint64(7) + _STEPS[np.minimum(count, len(_STEPS) - 1)]
    form = WORD_UNITS + (mixed(form) % np.uint64(FORM_UNITS)).astype(np.int32)
    return word, form, words.at


def context_sums(texts: Texts, index: np.ndarray, into: np.ndarray) -> None:
    """Adds to each unit the index vectors of the units around its words."""
    word, form, at = units(texts)
    n = len(word)
    if not n:
        return
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = index[word] + index[form]
    around = np.zeros_like(own)
    for step in range(1, WINDOW + 1):
        same = (text[step:] == text[:-step])[:, None]
        around[step:] += own[:-step] * same
        around[:-step] += own[step:] * same
    for d in range(DIMENSIONS):
        weights = np.ascontiguousarray(around[:, d])
        into[:, d] += np.bincount(word, weights, UNITS) + np.bincount(form, weights, UNITS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit-length vectors of all units, of a table of fixed size."""
    names = [f"d{k}" for k in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((UNITS, DIMENSIONS))
        for _, texts in chunks(batches):
            context_sums(texts, index, sums)
        used = np.flatnonzero(np.abs(sums).sum(axis=1) > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *map(pa.array, sums[used].T.copy())], ["unit", *names]
        )

    schema = "unit int, " + ", ".join(f"{n} double" for n in names)
    rows = docs.select("text").mapInArrow(run, schema)
    table = rows.groupBy("unit").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((UNITS, DIMENSIONS), np.float32)
    sums = np.stack([table.column(n).to_numpy() for n in names], axis=1)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    out[table.column("unit").to_numpy()] = sums / np.maximum(length, 1e-9)
    return out


def pooled(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each text."""
    word, form, at = units(texts)
    n = np.diff(at)
    out = np.zeros((len(n), FEATURES), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    starts, size = at[:-1][full], n[full, None]
    text = np.repeat(np.arange(len(n)), n)
    for k, unit in enumerate((word, form)):
        own = vectors[unit]
        mean = np.add.reduceat(own, starts, axis=0) / size
        square = np.add.reduceat(own * own, starts, axis=0) / size
        at_k = 2 * DIMENSIONS * k
        out[full, at_k : at_k + DIMENSIONS] = mean
        out[full, at_k + DIMENSIONS : at_k + 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean**2, 0))
    code = np.unique(text.astype(np.int64) * UNITS + word) // UNITS
    different = np.bincount(code, minlength=len(n))
    again = np.bincount(text[1:][(word[1:] == word[:-1]) & (text[1:] == text[:-1])], minlength=len(n))
    out[:, -4] = np.log1p(n)
    out[full, -3] = different[full] / n[full]
    out[full, -2] = again[full] / n[full]
    out[full, -1] = np.minimum(n[full], 50) / 50
    return out


def added_in_order(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The matrix product, each row's terms added from the first on.

    A library's product adds them in an order that depends on how many rows there are,
    so that one row would get another last digit in another batch.
    """
    out = np.zeros((len(x), w.shape[1]))
    for column, weights in zip(np.ascontiguousarray(x.T), w, strict=True):
        out += column[:, None] * weights
    return out


@dataclass
class Network:
    """Standardised features, one hidden layer of tanh, one output, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return added_in_order(np.tanh(added_in_order(x, self.w1) + self.b1), self.w2[:, None])[:, 0] + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    zeros = np.zeros((FEATURES, HIDDEN))
    return Network(np.zeros(FEATURES), np.ones(FEATURES), zeros, np.zeros(HIDDEN), np.zeros(HIDDEN), logit)


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> Network:
    """Adam on cross-entropy with weight decay; then the temperature on the rows kept back."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    draw = np.random.default_rng(3)
    x = x.astype(np.float64)
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    fit_x, fit_y = x[~back], y[~back]
    net = Network(
        fit_x.mean(axis=0),
        fit_x.std(axis=0) + 1e-3,
        draw.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)),
        np.zeros(HIDDEN),
        draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        0.0,
    )
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(rounds):
        order = draw.permutation(len(fit_y))
        for i in range(0, len(order), 128):
            rows = order[i : i + 128]
            a = np.clip((fit_x[rows] - net.mean) / net.scale, -8, 8)
            h = np.tanh(a @ net.w1 + net.b1)
            error = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) - fit_y[rows]
            error /= len(rows)
            hidden = np.outer(error, net.w2) * (1 - h * h)
            grads = {
                "w1": a.T @ hidden + 1e-4 * net.w1,
                "b1": hidden.sum(axis=0),
                "w2": h.T @ error + 1e-4 * net.w2,
                "b2": error.sum(),
            }
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - 2e-3 * change)
    if back.any():
        logits = net.logits(x[back])

        def loss(t: float) -> float:
            z = np.clip(logits / t, -40, 40)
            return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y[back]))

        net.temperature = min(np.geomspace(0.25, 8, 60), key=loss)
    return net


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``; ``labels``: the rows to learn from."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    vectors = word_vectors(docs)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            own = [row.tobytes() for row in pooled(texts, vectors)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(own, pa.binary())], ["doc_id", "features"]
            )

    features = written(docs.mapInArrow(pool, "doc_id long, features binary"), "pooled-vectors")
    wanted = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    wanted = wanted.dropna().groupBy("doc_id").agg(F.avg("y").alias("y"))
    one_each = features.join(wanted, "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features"))
    sample = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).toArrow()
    x = np.frombuffer(b"".join(sample.column("features").to_pylist()), np.float32).reshape(-1, FEATURES)
    net = fitted(x, sample.column("y").to_numpy())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(net.scores(own.reshape(-1, FEATURES).astype(float)))],
                ["doc_id", "score"],
            )

    return features.mapInArrow(judge, "doc_id long, score double")
