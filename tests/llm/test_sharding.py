from __future__ import annotations

import zlib

from skyledger.llm import queries, sharding
from tests.conftest import SMALL


def test_shards_are_balanced_stretches_of_the_order(spark):
    rows = queries.op8_sharding(spark, SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        content = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(content) + 8, zlib.crc32(content))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in ordered] == sorted(texts)
    # Brute force: the place of each middle byte.
    total, before, slots = sum(r.size for r in rows), 0, {}
    for r in ordered:
        assert r.shard == (2 * before + r.size) * 24 // (2 * total)
        assert r.slot == slots.setdefault(r.shard, 0)
        slots[r.shard] += 1
        before += r.size


def test_odd_rows(odd, empty):
    rows = sharding.assign_shards(sharding.document_sizes(odd), 3).collect()
    assert len(rows) == odd.count()
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.size for r in rows if r.text_crc32 == 0} == {8}
    assert sharding.assign_shards(sharding.document_sizes(empty), 3).count() == 0


def test_equal_rows_do_not_meet_in_one_range(spark, monkeypatch):
    """Nine of ten rows have a null id and no text."""
    kept = {}
    original = sharding.written

    def keep(df, name):
        kept[name] = original(df, name)
        return kept[name]

    monkeypatch.setattr(sharding, "written", keep)
    rows = [(i, "some text") for i in range(100)] + [(None, "")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sharding.assign_shards(sharding.document_sizes(df), 5).collect()
    parts = [r["count"] for r in kept["shard-rows"].groupBy("_part").count().collect()]
    assert len(parts) == 8 and max(parts) < 300
    assert len(found) == 1000
    for shard in range(5):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
