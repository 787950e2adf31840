from __future__ import annotations

import random
import re
from collections import defaultdict

from skyledger.llm import near_dedup, queries
from skyledger.llm.components import components
from tests.conftest import MEDIUM, SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text) -> frozenset:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected(docs) -> dict:
    """Brute force through an inverted index: size and component of each id."""
    sets = {i: shingle_set(text) for i, text in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for group in holders.values() for a in group for b in group if a < b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(rows, docs):
    wanted = expected(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id) == wanted[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_whole_tables_against_brute_force(spark):
    for folder in (SMALL, MEDIUM):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        check(queries.op9_near_dedup(spark, folder).collect(), docs)


def test_groups_and_chains_of_near_copies(spark):
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(5000)}"
    docs = []

    def add(words):
        docs.append((len(docs), " ".join(words)))

    base = [word() for _ in range(120)]
    for _ in range(80):  # near copies of one text, many of them below the limit to each other
        copy = list(base)
        for _ in range(draw.randrange(5)):
            copy[draw.randrange(120)] = word()
        add(copy)
    chain = [word() for _ in range(100)]
    for i in range(60):  # each like the one before, the ends nothing alike
        add(chain[i:] + chain[:i] if i % 2 else chain)
        chain = [*chain[4:], *[word() for _ in range(4)]]
    passage = [word() for _ in range(60)]
    for _ in range(60):  # a shared passage that makes no duplicates
        add([word() for _ in range(draw.randrange(10, 120))] + passage)
    for n in (1, 2, 4, 5, 6, 40, 41):
        own = [word() for _ in range(n)]
        for _ in range(3):
            add(own)
        add([*own, word()])
    draw.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(near_dedup.near_duplicates(df).collect(), docs)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)]
    edges += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    wanted = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {200 + i: 200 for i in range(9)}
    assert found == wanted


def test_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i for i in (1, 2, 3))
    assert by_id[8].n_shingles == by_id[9].n_shingles == by_id[4].n_shingles == 1
    assert all(r.kept for r in rows if r.doc_id is not None)
    assert near_dedup.near_duplicates(empty).count() == 0
