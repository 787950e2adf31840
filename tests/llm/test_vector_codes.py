from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from skyledger.llm import queries, vector_codes
from tests.conftest import MEDIUM, SMALL


def brute_force(rows):
    """(vec_id, code, error, label_error, digest) by full searches in Python's integers."""
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def find(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[find(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [
                [sum(c) // len(c) for c in zip(*parts, strict=True)] if parts else old
                for parts, old in zip(own, books[p], strict=True)
            ]
    out = []
    for i, v, label in kept:
        found = [find(part(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return [(i, code, error, sums[label], digest) for i, code, error, label in out]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_query_against_full_search(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    wanted = brute_force([(r.vec_id, r.embedding, r.label) for r in rows])
    assert ordered(queries.op11_vector_codes(spark, SMALL).collect()) == ordered(wanted)


def test_more_vectors_than_entries_ties_and_copies(spark):
    draw = random.Random(5)
    rows = []
    for i in range(700):  # few values, so many distances are equal
        v = [draw.randrange(-3, 4) / 4 for _ in range(8)]
        rows.append((1000 - i, v, draw.choice([None, 1, 2])))
    rows += [(2000 + i, [0.5] * 8, 3) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert ordered(vector_codes.compress(df).collect()) == ordered(brute_force(rows))


def test_clustered_balls_have_stable_cores_and_few_rings():
    draw = np.random.default_rng(1)
    centres = draw.integers(-10_000, 10_000, (60, 6))
    x = centres[draw.integers(0, 60, 3000)] + draw.integers(-50, 50, (3000, 6))
    first = vector_codes.Codebook(centres + draw.integers(-40, 40, (60, 6)))
    code, far = vector_codes.nearest(x, first)
    second = vector_codes.Codebook(centres, first)
    again = vector_codes.nearer(x, code, second)
    wanted = vector_codes.nearest(x, second)
    assert (again[0] == wanted[0]).all() and (again[1] == wanted[1]).all()
    # Nothing has moved: nothing is compared, and nothing changes.
    still = vector_codes.nearer(x, wanted[0], vector_codes.Codebook(centres, second))
    assert (still[0] == wanted[0]).all()


def test_large_components_are_compared_exactly():
    draw = np.random.default_rng(2)
    x = draw.integers(-(1 << 27), 1 << 27, (50, 5))
    d = vector_codes.distances(x, x[:9])
    assert all(
        int(d[i, j]) == sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], x[j], strict=True))
        for i in range(50)
        for j in range(9)
    )


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label string, code string, error string, x string, v string"
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, None), (2, []), (3, [1.0, None, 1.0, 1.0]), (4, [nan, 1.0, 1.0, 1.0]), (5, [inf, 1.0, 1.0, 1.0]),
        (6, [0.1, 0.2, 0.3, 0.4]), (6, [0.1, 0.2, 0.3, 0.4]), (7, [3.0e38, -3.0e38, 0.0, 0.0]),
        (8, [1.0] * 8), (9, [1.0] * 3), (None, [0.1, 0.2, 0.3, 0.5]), (10, [-0.1, -0.2, -0.3, -0.4]),
    ]
    rows = [(i, v, None if i in (6, None) else "a", "c", "e", "x", "v") for i, v in vectors]
    df = spark.createDataFrame(rows, schema)
    found = vector_codes.compress(df).collect()
    assert sorted(str(r.vec_id) for r in found) == ["10", "6", "6", "7", "None"]
    same = [(r.code, r.error) for r in found if r.vec_id == 6]
    assert same[0] == same[1]
    assert all(r.error >= 0 and len(r.code) == 8 for r in found)
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(df.filter("vec_id < 6")).count() == 0


def test_medium_table_is_coded_whole(spark):
    rows = queries.op11_vector_codes(spark, MEDIUM).collect()
    assert len(rows) == 500 and len({r.codebooks_sha256 for r in rows}) == 1
