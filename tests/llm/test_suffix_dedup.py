from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from skyledger.llm import queries, suffix_dedup
from skyledger.llm.words import Texts
from tests.conftest import MEDIUM, SMALL


def brute_force(docs):
    """(id, bytes, removed, spans, digest) through a dictionary of all strings of 50 bytes."""
    last = 1 << 63
    contents = [(last if i is None else i, (text or "").encode()) for i, text in docs]
    least = {}
    for i, b in contents:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            if least.get(s, last + 1) > i:
                least[s] = i
    out = []
    for i, b in contents:
        gone = bytearray(len(b))
        until = 0
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                at = max(p, until)
                gone[at : p + 50] = b"\1" * (p + 50 - at)
                until = p + 50
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((None if i == last else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    out = []
    for r in suffix_dedup.without_repeats(df).collect():
        spans = [(s.start, s.end) for s in r.spans]
        digest = hashlib.sha256(bytes(r.kept)).hexdigest()
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        out.append((r.doc_id, r.n_bytes, sum(b - a for a, b in spans), len(spans), digest))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("folder", [SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
def test_whole_tables_against_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert ordered(queries.op12_suffix_dedup(spark, folder).collect()) == ordered(brute_force(docs))


def planted(draw, n=150):
    """Texts with passages, near copies, runs of one letter, periods and edges."""
    letters = "abcdef"
    word = lambda k: "".join(draw.choice(letters) for _ in range(k))
    passages = [word(draw.choice([49, 50, 51, 60, 74, 75, 120, 400])) for _ in range(12)]
    base = word(600)
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            kind = draw.randrange(7)
            if kind == 0:
                parts.append(draw.choice(passages))
            elif kind == 1:
                p = draw.choice(passages)
                a = draw.randrange(len(p))
                parts.append(p[a : a + draw.randrange(40, 130)])
            elif kind == 2:
                copy = list(base)
                for _ in range(draw.randrange(6)):
                    copy[draw.randrange(len(copy))] = draw.choice(letters)
                parts.append("".join(copy))
            elif kind == 3:
                parts.append("x" * draw.choice([30, 49, 50, 51, 99, 200]))
            elif kind == 4:
                parts.append(("ab" if draw.random() < 0.5 else "abc") * draw.randrange(10, 60))
            elif kind == 5:
                parts.append("ünï\U0001f600 " * draw.randrange(3, 12))
            else:
                parts.append(word(draw.randrange(1, 200)))
        docs.append("".join(parts))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_passages_edges_and_periods(spark, monkeypatch, seed):
    draw = random.Random(seed)
    docs = list(enumerate(planted(draw)))
    draw.shuffle(docs)
    # Many runs, groups and ranges, whose borders cut through blocks of one anchor.
    monkeypatch.setattr(suffix_dedup, "RUN", 4000)
    monkeypatch.setattr(suffix_dedup, "GROUP", 500)
    monkeypatch.setattr(suffix_dedup, "RANGE", 120)
    monkeypatch.setattr(suffix_dedup, "STEP", 3)
    monkeypatch.setattr(suffix_dedup, "_HELD", [5, 60, 1000][seed])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert ordered(found(df)) == ordered(brute_force(docs))


def test_an_anchor_with_more_blocks_than_a_range_holds(spark, monkeypatch):
    """A passage at a different place of every document: its ends differ in all of them."""
    draw = random.Random(12)
    word = lambda k: "".join(draw.choice("lmnopqrs") for _ in range(k))
    passage = word(90)
    docs = [(i, word(draw.randrange(30, 90)) + passage + word(draw.randrange(30, 90))) for i in range(200)]
    monkeypatch.setattr(suffix_dedup, "RUN", 3000)
    monkeypatch.setattr(suffix_dedup, "RANGE", 50)
    monkeypatch.setattr(suffix_dedup, "STEP", 2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert ordered(found(df)) == ordered(brute_force(docs))


def test_repeated_ids_nulls_and_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", 300)
    draw = random.Random(9)
    a, b = ("".join(draw.choice("pqrstu") for _ in range(200)) for _ in range(2))
    docs = [(5, a), (5, a), (5, a + b), (None, b), (None, b), (7, b[20:90]), (3, a[100:160]), (9, None), (10, "")]
    docs += [(20 + i, a + "tail") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert ordered(found(df)) == ordered(brute_force(docs))


def test_a_passage_over_chunk_borders(monkeypatch):
    draw = random.Random(4)
    text = "".join(draw.choice("abcd") for _ in range(5000)).encode()
    texts = Texts(np.frombuffer(text, np.uint8), np.array([0, 100, 130, 179, 229, 5000]))
    whole = suffix_dedup.blocks_of(texts)
    places = suffix_dedup.gram_hashes(texts.bytes, np.arange(0, 4900, 7))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    cut = suffix_dedup.blocks_of(texts)
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True))
    assert (places == suffix_dedup.gram_hashes(texts.bytes, np.arange(0, 4900, 7))).all()
    assert whole[0].sum() == sum(max(0, n - 49) for n in np.diff(texts.at))


def test_merged_runs_against_sorting():
    draw = random.Random(6)
    for n in (1, 2, 3, 5, 8, 13):
        runs = []
        for _ in range(n):
            own = sorted({bytes(draw.choice(b"ab") for _ in range(8)) for _ in range(draw.randrange(40))})
            rows = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 8)
            again, common, _, _ = suffix_dedup.sorted_distinct(rows, np.zeros(len(rows), np.int64))
            back, prefix = suffix_dedup.decoded(*suffix_dedup.front_coded(again, common), 8)
            assert (back == rows).all()
            runs.append((own, prefix.tolist()))
        order, common = suffix_dedup.merged(runs, 8)
        at, out = [0] * n, []
        for k in order:
            out.append(runs[k][0][at[k]])
            at[k] += 1
        assert out == sorted(s for own, _ in runs for s in own)
        for a, b, c in zip(out, out[1:], common[1:], strict=False):
            assert c == next((i for i in range(8) if a[i] != b[i]), 8)


def test_odd_rows(odd, empty):
    rows = found(odd)
    assert ordered(rows) == ordered(brute_force([(r.doc_id, r.text) for r in odd.collect()]))
    assert suffix_dedup.without_repeats(empty).count() == 0
    assert suffix_dedup.without_repeats(odd.filter("doc_id < 4")).count() == 3
