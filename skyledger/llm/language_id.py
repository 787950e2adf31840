"""Language identification by Bayesian fusion of text, markup, address and host.

The posterior of a language is its host's prior times three likelihoods:

* text: four-byte grams of letters (and one blank between words), hashed into BUCKETS;
  counts from all labelled documents. Grams of one text are not independent, so n grams
  weigh as n / (1 + n / SATURATION).
* declared: the language in the markup, P(declared | language), so a wrong default that
  many pages declare says little.
* suffix: the last label of the address, P(suffix | language).
* host: the languages of its other documents (a document's own share is taken out),
  smoothed towards those of its parent domain, and these towards all rows.

The counts behind the last three are sums of text posteriors by declared value, suffix,
domain and host: grouped aggregations that start in the tasks, so a host with a third
of all rows is one row after them. The tables join back by their keys. A null value
gives no evidence.

``und`` stands for no known language: grams spread evenly, and no other evidence. A row
is accepted if it has letters and a known language is the likeliest. Null and empty
texts are not accepted (language ``und``, posterior 1). Every label with a gram is learnt,
however few rows have it, so the model has BUCKETS doubles for each label in the table
and a row two doubles; without any label every row is ``und``. Repeated rows count as
often as they occur; other columns than the named are left behind.

In ``known_languages`` a row's label is its declared language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import written
from skyledger.llm.words import Texts, chunks, mixed

BUCKETS = 1 << 14
SATURATION = 100
#: Languages whose counts a task holds at a time.
HELD = 64
#: Rows that a parent's shares weigh in the smoothing of its children.
STRENGTH = 5.0
UND = "und"
UND_PRIOR = 1e-4

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each gram, and the text it is of."""
    b, at = texts.bytes, texts.at
    letters = _LETTERS[b]
    # One blank between words, and around each text.
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = letters != 0x20
    if len(keep):
        new = np.zeros(len(keep), bool)
        new[1:] = text[1:] != text[:-1]
        keep[:-1] |= keep[1:] & ~new[1:]
    letters, text = letters[keep].astype(np.uint32), text[keep]
    n = len(letters)
    if n < 4:
        none = np.zeros(0, np.int64)
        return none, none
    key = (letters[:-3] << 24) | (letters[1:-2] << 16) | (letters[2:-1] << 8) | letters[3:]
    whole = text[:-3] == text[3:]
    key = mixed(key[whole].astype(np.uint64)) % np.uint64(BUCKETS)
    return key.astype(np.int64), text[:-3][whole]


@dataclass
class Model:
    """log P(bucket | language) with a row for each bucket; the last column is UND."""

    languages: list[str]
    log_p: np.ndarray

    @property
    def names(self) -> list[str]:
        return [*self.languages, UND]


def train(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Counts of grams by language over all rows that have a label."""
    rows = docs.select(F.lower(F.col(label)).alias("lang"), F.col(text).alias("text")).dropna()

    def entries(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        buckets = [np.flatnonzero(x) for x in sums.values()]
        lang = np.repeat(np.arange(len(sums), dtype=np.int32), [len(x) for x in buckets])
        n = [x[bucket] for x, bucket in zip(sums.values(), buckets, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.string()).take(pa.array(lang)),
                pa.array(np.concatenate([*buckets, np.zeros(0)]).astype(np.int32)),
                pa.array(np.concatenate([*n, np.zeros(0)]).astype(np.int64)),
            ],
            ["lang", "bucket", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in chunks(batches):
            coded = part.column("lang").dictionary_encode()
            key, text = grams(texts)
            own = coded.indices.to_numpy()[text]
            order = np.argsort(own, kind="stable")
            key, ends = key[order], np.searchsorted(own[order], np.arange(len(coded.dictionary) + 1))
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                if lang not in sums and len(sums) == HELD:
                    yield entries(sums)
                    sums = {}
                counts = np.bincount(key[ends[k] : ends[k + 1]], minlength=BUCKETS)
                sums[lang] = sums[lang] + counts if lang in sums else counts
        yield entries(sums)

    counted = rows.filter(F.col("lang") != UND).mapInArrow(run, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    coded = table.column("lang").combine_chunks().dictionary_encode()
    found = coded.dictionary.to_pylist()
    languages = sorted(found)
    place = np.array([languages.index(x) for x in found], np.int64)
    sums = np.zeros((BUCKETS, len(languages) + 1))
    sums[table.column("bucket").to_numpy(), place[coded.indices.to_numpy()]] = table.column("n").to_numpy()
    # Half of each distribution is even, so a gram not seen before costs little.
    even = np.full(BUCKETS, 1 / BUCKETS)[:, None]
    shares = 0.5 * sums / np.maximum(sums.sum(axis=0), 1) + 0.5 * even
    shares[:, -1] = 1 / BUCKETS
    return Model(languages, np.log(shares / shares.sum(axis=0)))


def _known(host: Column) -> Column:
    return F.when(F.trim(host) != "", F.lower(F.trim(host)))


def of_documents(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", declared: str | None = None
) -> DataFrame:
    """Evidence of documents: text, their source in the place of a host, a declared language."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("page_id"),
        F.col(text).alias("text"),
        (_known(F.col(declared)) if declared else none).alias("declared"),
        none.alias("suffix"),
        none.alias("domain"),
        F.concat(F.lit("source "), _known(F.col(source))).alias("host"),
    )


def of_pages(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Evidence of web pages: text without markup, declared language, suffix, domain, host."""
    host = _known(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    declared = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,8})""", 1)
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col(id_column).cast("long").alias("page_id"),
        plain.alias("text"),
        _known(declared).alias("declared"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        host.alias("host"),
    ).withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("suffix", "domain")})


EVIDENCE = ["declared", "suffix", "domain", "host"]


def _text_scores(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``n_grams``, ``log_text`` (weighed, by language) and ``p`` (text posterior)."""
    names = ["doc_id", "page_id", *EVIDENCE, "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            key, text = grams(texts)
            n = np.bincount(text, minlength=part.num_rows)
            logs = np.stack(
                [np.bincount(text, column[key], part.num_rows) for column in model.log_p.T],
                axis=1,
                dtype=float,  # without any gram bincount gives integers
            )
            logs /= (1 + n / SATURATION)[:, None]
            logs -= logs.max(axis=1, keepdims=True)
            p = np.exp(logs)
            p[:, -1] *= UND_PRIOR
            p /= p.sum(axis=1, keepdims=True)
            at = pa.array(np.arange(part.num_rows + 1) * logs.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *map(part.column, names),
                    pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(at, pa.array(logs.ravel())),
                    pa.ListArray.from_arrays(at, pa.array(p.ravel())),
                ],
                [*names, "n_grams", "log_text", "p"],
            )

    schema = ", ".join(["doc_id long, page_id long", *(f"{c} string" for c in EVIDENCE)])
    return rows.select(*names, "text").mapInArrow(
        run, f"{schema}, key long, n_grams long, log_text array<double>, p array<double>"
    )


def _sums(scored: DataFrame, by: str, size: int) -> DataFrame:
    """(by, <by>_n): the sum of text posteriors of each value that is not null."""
    places = [F.sum(F.get("p", F.lit(k))).alias(f"_{k}") for k in range(size)]
    rows = scored.filter(F.col(by).isNotNull() & (F.col("n_grams") > 0)).groupBy(by).agg(*places)
    return rows.select(by, F.array(*[f"_{k}" for k in range(size)]).alias(f"{by}_n"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)


def _smoothed(counts: Column, parent: Column) -> Column:
    """Shares of ``counts``, as if STRENGTH rows more had the parent's shares."""
    total = _total(counts) + STRENGTH
    return F.zip_with(counts, parent, lambda n, q: (n + STRENGTH * q) / total)


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """A row for each of ``rows`` (as from of_documents or of_pages) with its language."""
    size = len(model.names)
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    scored = written(_text_scores(rows, model), "text-scores")
    everything = scored.filter("n_grams > 0").agg(
        *[F.sum(F.get("p", F.lit(k))).alias(f"_{k}") for k in range(size)]
    )
    sums = np.array([x or 0.0 for x in everything.first()])
    shares = (sums + 1.0) / (sums.sum() + size)
    fused = scored
    for by in EVIDENCE:
        fused = fused.join(written(_sums(scored, by, size), f"{by}-counts"), by, "left")
    overall = F.array(*[F.lit(float(x)) for x in shares])
    sums_of = F.array(*[F.lit(float(x) + 1.0) for x in sums])

    def others(by: str) -> Column:
        """What the value's other rows have."""
        return F.zip_with(F.col(f"{by}_n"), F.col("p"), lambda n, own: F.greatest(n - own, F.lit(0.0)))

    def prior(by: str, parent: Column) -> Column:
        return F.coalesce(_smoothed(others(by), parent), parent)

    def likelihood(by: str) -> Column:
        """log of P(value | language) over P(value), smoothed towards 1."""
        counts, n = others(by), _total(others(by))
        ratio = F.zip_with(
            F.zip_with(counts, overall, lambda c, q: c + STRENGTH * q),
            sums_of,
            lambda c, all_of: c / (n + STRENGTH) * F.lit(float(sums.sum() + size)) / all_of,
        )
        return F.coalesce(F.transform(ratio, lambda x: F.log(x)), F.array_repeat(F.lit(0.0), size))

    fused = fused.withColumn("_domain", prior("domain", overall)).withColumn(
        "_host", prior("host", F.col("_domain"))
    )
    add = lambda a, b: a + b
    logs = F.zip_with(F.col("log_text"), F.transform("_host", lambda x: F.log(x)), add)
    logs = F.zip_with(F.zip_with(logs, likelihood("declared"), add), likelihood("suffix"), add)
    fused = fused.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    best = F.array_position("_logs", F.col("_top")).cast("int")
    text_best = F.array_position("p", F.array_max("p")).cast("int")
    names = F.array(*map(F.lit, model.names))
    there = F.col("n_grams") > 0
    language = F.when(there, F.get(names, best - 1)).otherwise(F.lit(UND))
    joint = _total(F.transform("_logs", lambda x: F.exp(x - F.col("_top"))))
    return fused.select(
        "doc_id",
        "page_id",
        "key",
        "host",
        "declared",
        language.alias("language"),
        F.when(there, 1 / joint).otherwise(F.lit(1.0)).alias("posterior"),
        F.when(there, F.get(names, text_best - 1)).otherwise(F.lit(UND)).alias("text_language"),
        "n_grams",
        (there & (language != UND)).alias("accepted"),
    )


def known_languages(
    docs: DataFrame, model: Model, text: str = "text", source: str = "source", label: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns.

    The label, where there is one, is the declared language: evidence for it as far as
    texts with that label agree. A decision depends on text, source and label, so the few
    that are not accepted are taken out by these; a copy in the same source with the same
    label goes the same way.
    """
    declared = label if label in docs.columns else None
    rows = of_documents(docs.withColumn("_id", F.lit(None)), "_id", text, source, declared)
    bad = identify(rows, model).filter(~F.col("accepted")).select("key", "host", "declared").distinct()
    bad = written(bad.toDF("_bad_key", "_bad_host", "_bad_declared"), "rejected-texts")
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    host = F.concat(F.lit("source "), _known(F.col(source)))
    says = _known(F.col(declared)) if declared else F.lit(None).cast("string")
    on = (key == F.col("_bad_key")) & host.eqNullSafe(F.col("_bad_host")) & says.eqNullSafe(F.col("_bad_declared"))
    return docs.join(bad, on, "left_anti")
