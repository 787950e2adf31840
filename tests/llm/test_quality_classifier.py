from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyledger.llm import quality_classifier as qc
from skyledger.llm import queries
from skyledger.llm.words import texts_of
from tests.conftest import MEDIUM


def test_held_out_quality(spark):
    rows = queries.op1_quality_classifier(spark, MEDIUM).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in out]) > 0.9


def test_context_sums_against_brute_force():
    texts = ["a b c d e", "", "x", "A b"]
    index = qc.index_vectors()
    found = np.zeros((qc.UNITS, qc.DIMENSIONS))
    qc.context_sums(texts_of(pa.array(texts)), index, found)
    wanted = np.zeros_like(found)
    word, form, at = qc.units(texts_of(pa.array(texts)))
    for a, b in zip(at[:-1], at[1:], strict=True):
        for i in range(a, b):
            for j in range(max(a, i - qc.WINDOW), min(b, i + qc.WINDOW + 1)):
                if i != j:
                    for unit in (word[i], form[i]):
                        wanted[unit] += index[word[j]] + index[form[j]]
    np.testing.assert_allclose(found, wanted, atol=1e-4)


def test_network_learns_and_is_calibrated():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, qc.FEATURES)).astype(np.float32)
    p = 1 / (1 + np.exp(1 - 4 * x[:, 0] - 2 * np.maximum(x[:, 1], 0)))
    y = (draw.random(4000) < p).astype(float)
    net = qc.fitted(x[:3000], y[:3000])
    scores = net.scores(x[3000:].astype(float))
    assert np.mean((scores > 0.5) == (p[3000:] > 0.5)) > 0.8
    high = scores > 0.8
    assert abs(y[3000:][high].mean() - scores[high].mean()) < 0.12


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (4, 1), (5, None), (None, 1), (8, 0), (8, 0), (99, 1)], "doc_id long, quality int"
    )
    rows = qc.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    assert qc.score(empty, labels).count() == 0
    none = qc.score(odd, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    same = qc.score(odd, labels.filter(F.col("quality") == 1)).collect()
    assert all(r.score > 0.99 for r in same)


def test_a_row_scores_the_same_in_any_batch():
    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (400, qc.FEATURES)).astype(np.float32).astype(float)
    net = qc.fitted(x, (x[:, 0] + draw.normal(0, 1, 400) > 0).astype(float), rounds=3)
    row = draw.normal(0, 1, qc.FEATURES).astype(np.float32).astype(float)
    scores = set()
    for n in range(1, 101):
        rows = np.concatenate([x[:n], row[None], x[n : 2 * n]])
        scores.add(net.scores(rows)[n])
        scores |= set(net.scores(np.repeat(row[None], n, axis=0)))
    assert len(scores) == 1


def test_ids_with_different_texts_are_learnt_alike_in_any_order(spark):
    rows = [(i % 40, f"text {i} of some words {'again ' * (i % 7)}") for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = []
    for parts, order in ((1, rows), (5, rows[::-1])):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        found.append(sorted((r.doc_id, round(r.score, 9)) for r in qc.score(docs, labels).collect()))
    assert found[0] == found[1]
