"""The registered queries: each operator with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import (
    bpe,
    decontaminate,
    hmm,
    language_id,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    resampling,
    secrets,
    sharding,
    suffix_dedup,
    vector_codes,
)
from skyledger.llm.store import small_batches
from skyledger.plans import scratch_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def multi_language_bpe() -> bpe.Vocabulary:
    return bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def id_remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id is an empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").filter(id_remainder(5) != 0)
    scored = quality_classifier.score(table(spark, folder, "documents"), labels)
    return scored.select(
        "doc_id",
        (id_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return hmm.train_and_score(docs, held_out=id_remainder(7) == 2)


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.Ledger(spark, scratch_folder(spark, "ledger")).scan(docs, path="doc_id")
    return secrets.digest(found).withColumnRenamed("path", "doc_id")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.leaks(docs, benchmark)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    found = language_id.identify(
        language_id.of_documents(docs).unionByName(language_id.of_pages(pages)),
        language_id.train(docs),
    )
    return found.select(
        "doc_id", "page_id", "language", "posterior", "text_language", "n_grams", "accepted"
    )


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack(docs, multi_language_bpe(), length=2048, end_id=50256)


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, multi_language_bpe(), decoded="decoded")
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sizes = sharding.document_sizes(table(spark, folder, "documents"))
    return sharding.assign_shards(sizes, 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A line is common in a host where more than 10 of its different texts and more than
    2 % of them have it: ten, so that a small host's chance repeats stay; two percent, so
    that what a large host's authors write again and again is not taken for boilerplate.
    """
    limits = quality_rules.LineLimits(documents=10, percent_of_host=2)
    return quality_rules.judge(table(spark, folder, "documents"), limits=limits)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    drawn = resampling.resample(docs, benchmark, percent=10, least_words=20, salt="2024")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
