from __future__ import annotations

import base64

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from skyledger.llm import language_id, near_dedup, secrets
from tests.conftest import MEDIUM, SMALL
from tests.llm import test_decontaminate, test_language_id, test_near_dedup


@pytest.fixture(scope="module")
def stages(spark):
    """The output of every stage."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], MEDIUM).persist())
    yield out
    for df in out[1:]:
        df.unpersist()


def test_stages_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "decontamination", "secrets", "tokens",
    ]


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()


def test_language_keeps_clean_documents(stages):
    docs = {r.doc_id: r for r in stages[0].collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    # Brute force, in which a document's label is its declared language.
    rows = language_id.of_documents(stages[0], declared="lang").collect()
    found = test_language_id.brute_fusion(rows, language_id.train(stages[0]))
    assert kept == {r.doc_id for r, n, language, _ in found if n and language != language_id.UND}
    assert len(kept) > 0.98 * len(docs)


def test_one_near_duplicate_stays(stages):
    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    wanted = {i for i, (_, least) in test_near_dedup.expected(docs).items() if i == least}
    assert {r.doc_id for r in stages[2].collect()} == wanted
    assert len(wanted) < len(docs)


def test_leaks_go(spark, stages):
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    bad = {doc for doc, _ in test_decontaminate.expected(docs, items)}
    assert bad and {r.doc_id for r in stages[3].collect()} == {i for i, _ in docs} - bad


def test_secrets_are_replaced_and_rows_stay(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    changed = 0
    for i, r in before.items():
        spans = secrets.spans_of(r.text, secrets.RULES)
        assert after[i].text == secrets.without(r.text, spans)
        assert (after[i].lang, after[i].source, after[i].n_chars) == (r.lang, r.source, len(after[i].text))
        changed += bool(spans)
    assert changed


def test_tokens_and_run(spark, stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = corpus_pipeline.run(spark, MEDIUM).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    context = spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        assert corpus_pipeline.run(spark, SMALL).count() > 0
        (folder,) = [p for p in tmp_path.iterdir() if p.is_dir()]
        names = {p.name.rsplit("-", 1)[0] for p in folder.iterdir()}
        assert names <= {"secrets", "ledger"}
    finally:
        context.setCheckpointDir(before.rsplit("/", 1)[0])


def test_overlapping_spans():
    spans = [{"kind": k, "start": a, "end": b} for k, a, b in (("x", 2, 5), ("y", 4, 7), ("z", 8, 9))]
    assert secrets.without("0123456789", spans) == "01[x]7[z]9"


def test_odd_rows(spark, odd, empty):
    docs = odd.withColumnRenamed("n_tokens", "n_chars").drop("ids")
    one = near_dedup.one_of_each(docs).collect()
    assert len(one) == docs.count() - 1  # the repeated row
    assert sorted(r.doc_id for r in one if r.doc_id) == [*range(1, 12), 20, 21]
    plain = odd.select("doc_id", "text", "source", "lang")
    for name, stage in corpus_pipeline.STAGES:
        for df in (plain, plain.limit(0)):
            out = stage(spark, df, MEDIUM)
            rows = out.collect()
            assert name == "tokens" or out.columns == plain.columns
            assert len(rows) <= df.count() and (df is plain) == bool(rows)


def test_null_ids_are_kept_once_by_their_text(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(None, words), (None, words), (None, words + " x"), (7, words + " y"), (None, None), (None, None)]
    rows += [(9, "a b c"), (9, "d e f"), (9, "d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.one_of_each(df).collect()
    assert sorted(map(str, kept)) == sorted(
        map(str, spark.createDataFrame([(7, words + " y"), (None, None), (None, None), (9, "a b c"), (9, "d e f")], df.schema).collect())
    )


def shuffled_rows(df) -> int:
    """What the exchanges in the plan of ``df``, which has run without adaptive execution, have written."""

    def of(node) -> int:
        own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        children = node.children()
        return own + sum(of(children.apply(k)) for k in range(children.size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_rows_that_stay_are_not_shuffled(spark):
    """However many rows go, which a broadcast join hides while they are few."""
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(200)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(300, texts[5]), (301, texts[6]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        kept = near_dedup.one_of_each(df)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
        assert shuffled_rows(kept) < 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
