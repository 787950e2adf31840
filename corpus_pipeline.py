"""Documents to token ids in stages, each written as Parquet and read by the next.

1. language: rows without letters or in no known language go.
2. near_duplicates: of each group of near copies one row stays, of least id.
3. decontamination: rows in which a benchmark item is found go.
4. secrets: rows stay, with each secret in their text replaced by its kind.
5. tokens: one row of token ids for each document that is left.

All but the last return the columns of documents. SQL cannot express the language
model of the first stage, nor the merges of the last, so ORACLE_SQL is None; the stages
are tested against brute force, one by one and as a whole.

Null and empty texts go at the first stage. Rows with equal ids and texts are copies of
each other, of which the second keeps one; rows with a null id are compared and kept by
their text. Tables of other columns keep them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import bpe, decontaminate, language_id, near_dedup, secrets
from skyledger.llm.queries import multi_language_bpe, table
from skyledger.llm.store import cleared, kept, remove, small_batches
from skyledger.plans import scratch_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language; the text model learns from the labelled rows of ``docs``."""
    small_batches(spark)
    return language_id.known_languages(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.redacted(docs, secrets.Ledger(spark, scratch_folder(spark, "ledger")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    small_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), multi_language_bpe())
    return coded.selectExpr("doc_id", "lang", "source", "size(ids) as n_tokens", "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents in ``sf_dir``.

    Tables that a stage writes for itself, and what the stage before has left, are deleted
    once its own rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with cleared(spark):
            docs, path = kept(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
