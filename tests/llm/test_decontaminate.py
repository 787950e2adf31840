from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from skyledger.llm import decontaminate, queries
from skyledger.llm.words import mixed
from tests.conftest import MEDIUM

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text) -> list[tuple]:
    words = WORD.findall((text or "").translate(UPPER))
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def expected(docs, items) -> dict:
    """Brute force: the best similarity of every document and item, over all windows."""
    found = {}
    prepared = [(i, shingles(text)) for i, text in items]
    for doc_id, text in docs:
        own = shingles(text)
        there = set(own)
        for item_id, item in prepared:
            if not item or not own or not there.intersection(item):
                continue
            wanted, n = Counter(item), min(len(item), len(own))
            best = 0
            for s in range(len(own) - n + 1):
                window = Counter(own[s : s + n])
                shared = sum((window & wanted).values())
                best = max(best, shared / (n + len(item) - shared))
            if best >= 0.75:
                found[doc_id, item_id] = best
    return found


def test_whole_tables_against_brute_force(spark):
    read = lambda name: spark.read.parquet(f"{MEDIUM}/{name}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").collect()]
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    rows = queries.op4_decontamination(spark, MEDIUM).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == expected(docs, items)
    clean = decontaminate.without_leaks(read("documents"), read("benchmark"))
    bad = {r.doc_id for r in rows}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - bad
    assert clean.columns == read("documents").columns


def edited_passages():
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(4000)}"
    items = [(i, [word() for _ in range(draw.choice([3, 5, 6, 17, 40, 59, 200]))]) for i in range(80)]
    items.append((80, items[0][1]))
    docs = []
    for _ in range(600):
        words = list(draw.choice(items)[1])
        for _ in range(draw.randrange(4)):
            k = draw.randrange(len(words))
            words[k : k + draw.randrange(2)] = [word()] * draw.randrange(3)
            words = words or ["x"]
        before, after = ([word() for _ in range(draw.randrange(60))] for _ in range(2))
        docs.append((len(docs), " \n".join([*before, *words, *after]).title()))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_edited_passages_against_brute_force(spark, monkeypatch):
    docs, items = edited_passages()
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(4)
    wanted = expected(docs, items)
    assert len(wanted) > 100
    for most in (decontaminate.INDEX_ITEMS, 9):  # one index, and many
        monkeypatch.setattr(decontaminate, "INDEX_ITEMS", most)
        rows = decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()
        found = {(r.doc_id, r.item_id): r.similarity for r in rows}
        assert len(found) == len(rows)
        assert found == wanted


def test_blocks_find_all_within_the_radius():
    draw = np.random.default_rng(1)
    items = [draw.integers(0, 1 << 63, 30, dtype=np.uint64) for _ in range(50)]
    index = decontaminate.Index(list(range(50)), items)
    for k in range(50):
        changed = index.prints[k].copy()
        flips = draw.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False)
        np.bitwise_xor.at(changed, flips // 8, np.uint8(1) << (flips % 8).astype(np.uint8))
        found = np.bitwise_or.reduce([index.near[j][changed[j]] for j in range(decontaminate.BLOCKS)])
        assert found[k // 64] >> np.uint64(k % 64) & np.uint64(1)


def test_sliding_fingerprints_are_those_of_each_window():
    draw = np.random.default_rng(4)
    for values, n, size in ((1 << 60, 40, 7), (3, 60, 11), (1, 30, 6), (12, 90, 40), (5, 9, 9)):
        h = mixed(draw.integers(0, values, n, dtype=np.uint64))
        starts = np.arange(n - size + 1)
        together = decontaminate.fingerprints(h, starts, size)
        for s in starts:
            own = h[s : s + size]
            alone = decontaminate.fingerprints(own, np.zeros(1, np.int64), size)
            assert (together[s] == alone[0]).all()
            shuffled = decontaminate.fingerprints(draw.permutation(own), np.zeros(1, np.int64), size)
            assert (shuffled == alone).all()  # a set has no order


def test_nothing_is_found_without_the_blocks(spark, monkeypatch):
    """Hits come through the fingerprints alone."""
    docs, items = edited_passages()
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    made = decontaminate.Index.__init__

    def emptied(self, *arguments):
        made(self, *arguments)
        self.near[:] = 0

    monkeypatch.setattr(decontaminate.Index, "__init__", emptied)
    assert decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id")).count() == 0


def test_odd_rows(spark, odd, empty):
    schema = "item_id long, text string, kept string"
    bench = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (None, "ONE two\tthree four FIVE", "x")], schema
    )
    rows = decontaminate.leaks(odd, bench).collect()
    assert sorted((r.doc_id, r.item_id or -1) for r in rows) == [(4, 3), (6, -1), (6, -1)]
    assert decontaminate.without_leaks(odd, bench).count() == odd.count() - 3
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == odd.count()


def test_cut_passages_before_repeated_words_against_brute_force(spark):
    draw = random.Random(5)
    items = [(i, [f"w{draw.randrange(4000)}" for _ in range(204)]) for i in range(30)]
    items += [(30 + i, w[:100] + ["again", "and"] * 40) for i, w in items[:10]]
    docs = []
    for i, words in items:
        for filler in (["junk"], ["a", "b", "c", "d", "e"]):
            docs.append((len(docs), " ".join(words[: 176 if i < 30 else 160] + filler * (200 // len(filler)))))
    docs += [(1000, "again and " * 300), (1001, " ".join(items[0][1][:170]))]
    items = [(i, " ".join(w)) for i, w in items]
    wanted = expected(docs, items)
    assert len(wanted) >= 60
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(4)
    rows = decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == wanted
