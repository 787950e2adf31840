from __future__ import annotations

import base64
import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skyledger.llm import bpe, queries
from skyledger.llm.words import texts_of
from tests.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def encoded(texts: list[str]) -> list[list[int]]:
    import pyarrow as pa

    ids, at = bpe.load(PATH).encode(texts_of(pa.array(texts)))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_ids_and_bytes_against_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op7_byte_bpe(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_random_texts(library):
    draw = random.Random(5)
    pieces = [
        *" \t\n\r'  ", "  ", "'s", "'re", "'ll", "'LL", "'d", "ve", "don't", "''s", " 's", "\n's", "x's1",
        "é", "Ünder", "日本", "\U0001f600", "12", "٣", "½", "!?", "<|endoftext|>", "a", "the", "\x1c", "\x85", "ſ",
        "é", "​", "　", "AKIA",
    ]
    texts = ["".join(draw.choices(pieces, k=draw.randrange(12))) for _ in range(4000)]
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert ids == library.encode_ordinary(text), repr(text)


def test_character_classes_are_the_librarys():
    """Whether a character goes on a letter, a digit or a mark, for all code points."""
    tokens = [bytes([x]) for x in range(256)] + [bytes([p, x]) for p in b"a1!" for x in range(256)]
    library = tiktoken.Encoding(
        "pairs",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={token: rank for rank, token in enumerate(tokens)},
        special_tokens={},
    )
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    own = bpe.character_classes()[points]
    for before, kind in (("a", bpe._LETTER), ("1", bpe._NUMBER), ("!", bpe._OTHER)):
        joined = [library.encode_ordinary(before + chr(c))[0] >= 256 for c in points]
        wrong = np.flatnonzero(np.array(joined) != (own == kind))
        assert not len(wrong), (before, [hex(points[k]) for k in wrong[:9]])


def thue_morse(n: int) -> str:
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [16, 32, 512, 1024, 2048, 4096])
def test_words_that_collide_in_polynomials(library, n):
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one} {other}", other, one, f"x {one}", f"x {other}"]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_merged_pretokens_survive_a_change_of_halves(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 8)
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("qxzjk", k=9)) for _ in range(6)) for _ in range(40)]
    for _ in range(2):
        assert [encoded([t])[0] for t in texts] == [library.encode_ordinary(t) for t in texts]

def test_long_pieces(library):
    texts = ["x" * 20000, "ab" * 5000 + " " * 3000, "é" * 4000]
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert ids == library.encode_ordinary(text)


def test_short_pieces_are_merged_together(library, monkeypatch):
    import pyarrow as pa

    draw = random.Random(11)
    words = ["".join(draw.choices("qxzjkaeioé日1!'", k=draw.randrange(1, 11))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=draw.randrange(30))) for _ in range(200)]
    long = "x" * 40 + " " + "jqxz" * 20 + " qxzj"

    def together(texts: list[str]) -> list[list[int]]:
        ids, at = bpe.load(PATH).encode(texts_of(pa.array(texts)), together=True)
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]

    mixed = [*texts, long, "", texts[0] + " " + long + " " + texts[1]]
    assert together(mixed) == [library.encode_ordinary(t) for t in mixed]
    monkeypatch.setattr(bpe.Merges, "merged", lambda *_: pytest.fail("a heap for a short piece"))
    assert together(texts) == [library.encode_ordinary(t) for t in texts]


def test_pairs_of_any_ranks_against_the_heap():
    """Ranks in random order, so that a token can come before those it is made of."""
    draw = random.Random(2)
    tokens = [bytes([x]) for x in range(256)]
    tokens += sorted({bytes(draw.choices(b"abc", k=draw.randrange(2, 6))) for _ in range(150)})
    ids = list(range(len(tokens)))
    draw.shuffle(ids)
    ranks = dict(zip(tokens, ids, strict=True))
    pieces = [bytes(draw.choices(b"abcd", k=draw.randrange(1, 33))) for _ in range(2000)]
    ends = np.cumsum([len(p) for p in pieces])
    flat, sizes = bpe.Pairs(ranks).merged(
        np.frombuffer(b"".join(pieces), np.uint8), ends - [len(p) for p in pieces], ends
    )
    own = np.split(flat, np.cumsum(sizes)[:-1])
    heap = bpe.Merges(ranks)
    assert [x.tolist() for x in own] == [heap.merged(p) for p in pieces]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    slots = bpe.PerfectHash(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(5000))


def test_odd_rows(odd, empty, library):
    vocabulary = bpe.load(PATH)
    rows = bpe.decode(bpe.encode(odd.drop("ids"), vocabulary), vocabulary).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    texts = {(r.doc_id, r.source): r.text or "" for r in odd.collect()}
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id, r.source])
        assert bytes(r.decoded).decode() == texts[r.doc_id, r.source]
        assert r.size == "extra"
    assert bpe.encode(odd, vocabulary).count() == len(rows)
    at_once = bpe.encode(odd.drop("ids"), vocabulary, decoded="decoded")
    assert sorted(map(str, at_once.collect())) == sorted(map(str, rows))
    assert bpe.encode(empty, vocabulary).count() == 0
