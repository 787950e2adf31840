from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skyledger.llm import hmm, queries
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def tokens(text) -> list[str]:
    return [*WORD.findall((text or "").translate(UPPER)), "\n"]


def check_base(rows, docs):
    train = Counter(t for i, text in docs if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    texts = dict(docs)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.train_tokens) == (len(own), n)
        assert r.n_known == sum(train[t] > 0 for t in own)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)


@pytest.mark.parametrize("common", [hmm.COMMON, 50])
def test_counts_and_base_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(hmm, "COMMON", common)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.op2_lm_scoring(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    check_base(rows, docs)
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_forward_is_the_sum_over_all_paths():
    draw = np.random.default_rng(4)
    share = draw.random(hmm.CLASSES + 1)
    model = hmm.Model.first(share / share.sum())
    model.move = draw.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    sequences = [draw.integers(0, hmm.CLASSES + 1, n).astype(np.uint16) for n in (1, 3, 2, 4)]
    at = np.cumsum([0, *map(len, sequences)])
    found = hmm.log_likelihoods(model, np.concatenate(sequences), at)
    for own, score in zip(sequences, found, strict=True):
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(own)):
            p = model.start[0, path[0]] * model.emit[own[0], path[0]]
            for a, b, kind in zip(path, path[1:], own[1:], strict=False):
                p *= model.move[a, b] * model.emit[kind, b]
            total += p
        assert score == pytest.approx(math.log10(total), rel=1e-9)


def test_expected_counts_against_brute_force():
    draw = np.random.default_rng(6)
    share = draw.random(hmm.CLASSES + 1)
    model = hmm.Model.first(share / share.sum())
    own = draw.integers(0, hmm.CLASSES + 1, 4).astype(np.uint16)
    weight, starts, moves, emits = 0.0, np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), Counter()
    for path in itertools.product(range(hmm.STATES), repeat=len(own)):
        p = model.start[0, path[0]] * model.emit[own[0], path[0]]
        for a, b, kind in zip(path, path[1:], own[1:], strict=False):
            p *= model.move[a, b] * model.emit[kind, b]
        weight += p
        starts[path[0]] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
        for kind, state in zip(own, path, strict=True):
            emits[int(kind), state] += p
    expected = hmm.Expected(model)
    expected.add(np.concatenate([own, own]), np.array([0, 4, 8]))
    np.testing.assert_allclose(expected.start[0], 2 * starts / weight, rtol=1e-3)
    np.testing.assert_allclose(expected.move, 2 * moves / weight, rtol=1e-3)
    for (kind, state), p in emits.items():
        assert expected.emit[kind, state] == pytest.approx(2 * p / weight, rel=1e-3)


def test_training_raises_the_likelihood(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    total = [
        hmm.train_and_score(docs, queries.id_remainder(7) == 2, iterations=n).agg({"score": "sum"}).first()[0]
        for n in (0, 2, 5)
    ]
    assert total == sorted(total)


def test_odd_rows(odd, empty):
    rows = hmm.train_and_score(odd, queries.id_remainder(7) == 2).collect()
    assert len(rows) == odd.count()
    assert all(math.isfinite(r.score) and r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert hmm.train_and_score(empty, queries.id_remainder(7) == 2).count() == 0
    from pyspark.sql import functions as F

    untrained = hmm.train_and_score(odd, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in untrained)
