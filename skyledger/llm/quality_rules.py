"""Quality rules on whole texts, and lines that many documents of a host share.

Built-in functions only. Rules of one document: too few words, too many words in
repeated three-word windows. Across documents: each line is normalised (lower case,
white space squeezed) and hashed; the documents of a host that have it are counted,
documents with equal text once; a line in more than ``LineLimits`` allows is removed
from that host, and a document is depleted when over half of its words go.
``removed_lines`` finds these lines, ``without_lines`` takes them out of the texts, and
``depleted_documents`` derives its verdicts from the same lines.

Lines are counted in two steps. The first counts rows per host and line, which map-side
sums keep small however common a line is; only lines over the lower limit go on, and of
these few the second counts different texts. A row count is never below the count of
texts, so nothing is lost.

Null and empty texts have no words and fail; a null host is a host of its own; repeated
rows each get the same verdict; lines without a word are not counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import written

# White space between words, symbols, and the two base rules.
BLANK = r"[\x20\x09-\x0D]"
BLANK_IN_LINE = r"[\x20\x09\x0B-\x0D]"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS = 50
REPEATED_PERCENT = 50
WINDOW = 3


@dataclass(frozen=True)
class LineLimits:
    """A line is removed in a host where more documents have it than both limits."""

    documents: int = 10
    percent_of_host: int = 2
    #: A document is depleted when more than this share of its words is removed.
    depleted_percent: int = 50


def _covered(positions: Column) -> Column:
    """Words in the windows that begin at ``positions`` (ascending, distinct)."""
    gaps = F.transform(
        positions,
        lambda p, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(positions, j + 1) - p, F.lit(WINDOW))
        ),
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts of each text, ``_text_key`` and ``base_failed``."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    kept = docs.columns
    words = F.col("_words")
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    windows = F.col("_windows")
    # Only texts where some window comes twice are sorted.
    ordered = F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    s = F.col("_ordered")
    repeated = F.filter(
        s,
        lambda x, j: F.coalesce((j > 0) & (F.get(s, j - 1)["h"] == x["h"]), F.lit(False))
        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
    )
    n_words, n_repeat = F.col("n_words"), F.col("n_repeat_words")
    return (
        docs.withColumn("_words", F.array_remove(F.split(content, BLANK + "+"), ""))
        .withColumn("_lines", lines)
        .withColumn(
            "_windows",
            F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("_ordered", ordered)
        .withColumn("_repeated", F.sort_array(F.transform(repeated, lambda x: x["i"])))
        .select(
            *kept,
            F.unhex(F.md5(content.cast("binary"))).alias("_text_key"),
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(content, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            _covered(F.col("_repeated")).alias("n_repeat_words"),
        )
        .withColumn(
            "base_failed",
            (n_words < LEAST_WORDS) | (100 * n_repeat > REPEATED_PERCENT * n_words),
        )
    )


def normalised_lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """Host, text key and an array of the normalised lines that have a word."""
    content = F.coalesce(F.col(text), F.lit(""))
    squeezed = F.regexp_replace(F.lower(content), BLANK_IN_LINE + "+", " ")
    lines = F.transform(F.split(squeezed, "\n"), lambda line: F.btrim(line))
    return docs.select(
        F.col(host).alias("_host"),
        F.unhex(F.md5(content.cast("binary"))).alias("_text_key"),
        F.array_remove(lines, "").alias("_lines"),
    )


def _line_texts(
    docs: DataFrame, texts: DataFrame, host: str, text: str, limits: LineLimits
) -> DataFrame:
    """Lines that may be removed, by host and different text, with the words they hold there.

    ``texts`` has _host and _text_key of every document.
    """
    lines = normalised_lines(docs, host, text)
    hashes = F.array_distinct(F.transform("_lines", lambda line: F.xxhash64(line)))
    rows = (
        lines.select("_host", F.explode(hashes).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > limits.documents)
    )
    hosts = (
        texts.select("_host", "_text_key").distinct().groupBy("_host").agg(F.count("*").alias("_texts"))
    )
    limit = F.greatest(
        F.lit(limits.documents) * 100, F.col("_texts") * limits.percent_of_host
    )
    common = written(
        rows.alias("r")
        .join(hosts.alias("h"), F.col("r._host").eqNullSafe(F.col("h._host")))
        .filter(100 * F.col("_rows") > limit)
        .select("r._host", "_line", limit.alias("_limit")),
        "common-lines",
    )
    # Their occurrences by different text, with the words they hold there.
    exploded = lines.select("_host", "_text_key", F.explode("_lines").alias("_text")).select(
        "_host",
        "_text_key",
        F.xxhash64("_text").alias("_line"),
        F.size(F.split("_text", " ")).alias("_n"),
    )
    on = (F.col("e._host").eqNullSafe(F.col("c._host"))) & (F.col("e._line") == F.col("c._line"))
    return written(
        exploded.alias("e")
        .join(common.alias("c"), on)
        .groupBy("e._host", "e._text_key", "e._line", "_limit")
        .agg(F.sum("_n").alias("_n"), F.count("*").alias("_times")),
        "common-line-texts",
    )


def _over_limits(found: DataFrame) -> DataFrame:
    """(_host, _line) of the lines of _line_texts that more texts have than the limit."""
    return (
        found.groupBy("_host", "_line", "_limit")
        .agg(F.count("*").alias("_texts"))
        .filter(100 * F.col("_texts") > F.col("_limit"))
        .select("_host", "_line")
    )


def removed_lines(
    docs: DataFrame, host: str = "source", text: str = "text", limits: LineLimits = LineLimits()
) -> DataFrame:
    """(_host, _line): each line that is removed in a host, as the hash of its normal form."""
    texts = docs.select(
        F.col(host).alias("_host"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("_text_key"),
    )
    return written(_over_limits(_line_texts(docs, texts, host, text, limits)), "removed-lines")


def without_lines(
    docs: DataFrame, removed: DataFrame, host: str = "source", text: str = "text"
) -> DataFrame:
    """``docs`` with all rows and columns, each text without the ``removed`` lines of its host.

    Only texts that have such a line are rebuilt, each different one of a host once, from
    its other lines in their order. The rest, null ones too, are as they were. Other
    columns that depend on the text are not changed.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.md5(content.cast("binary")))
    # Places of lines as in normalised_lines(): the same breaks, none left out.
    squeezed = F.regexp_replace(F.lower(content), BLANK_IN_LINE + "+", " ")
    hashes = F.transform(F.split(squeezed, "\n"), lambda line: F.xxhash64(F.btrim(line)))
    places = docs.select(
        F.col(host).alias("_host"), key.alias("_text_key"), F.posexplode(hashes).alias("_at", "_line")
    )
    on = F.col("p._host").eqNullSafe(F.col("g._host")) & (F.col("p._line") == F.col("g._line"))
    gone = written(
        places.alias("p")
        .join(removed.alias("g"), on, "left_semi")
        .groupBy("_host", "_text_key")
        .agg(F.collect_set("_at").alias("_gone"))
        .toDF("_gone_host", "_gone_key", "_gone"),
        "removed-places",
    )
    lines = F.filter(F.split(content, "\n"), lambda line, i: ~F.array_contains("_gone", i))
    rebuilt = F.when(F.col("_gone").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col(text))
    on = F.col(host).eqNullSafe(F.col("_gone_host")) & (key == F.col("_gone_key"))
    return docs.join(gone, on, "left").select(*[rebuilt.alias(c) if c == text else F.col(c) for c in docs.columns])


def depleted_documents(
    docs: DataFrame, sizes: DataFrame, host: str, text: str = "text", limits: LineLimits = LineLimits()
) -> DataFrame:
    """(_host, _text_key) of each document that loses too many words.

    ``sizes`` has _host, _text_key and n_words of every document.
    """
    found = _line_texts(docs, sizes, host, text, limits)
    removed = _over_limits(found)
    on = (F.col("f._host").eqNullSafe(F.col("g._host"))) & (F.col("f._line") == F.col("g._line"))
    lost = (
        found.alias("f")
        .join(removed.alias("g"), on, "left_semi")
        .groupBy("_host", "_text_key")
        .agg(F.sum("_n").alias("_lost"))
    )
    # Rows with one host and text were summed together: compare with their words together.
    words = sizes.groupBy("_host", "_text_key").agg(F.sum("n_words").alias("_words"))
    on = (F.col("l._host").eqNullSafe(F.col("w._host"))) & (F.col("l._text_key") == F.col("w._text_key"))
    return (
        lost.alias("l")
        .join(words.alias("w"), on)
        .filter(100 * F.col("_lost") > limits.depleted_percent * F.col("_words"))
        .select("l._host", "l._text_key")
    )


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    host: str = "source",
    text: str = "text",
    limits: LineLimits = LineLimits(),
) -> DataFrame:
    """A row for each document: id, counts, ``base_failed``, ``depleted`` and ``kept``.

    Other columns of ``docs`` are left behind, whatever their names.
    """
    docs = docs.select(
        F.col(id_column).alias("doc_id"), F.col(host).alias("_host"), F.col(text).alias("text")
    )
    rows = written(measured(docs).drop("text"), "quality-counts")
    bad = depleted_documents(docs, rows.select("_host", "_text_key", "n_words"), "_host", "text", limits)
    on = (F.col("r._host").eqNullSafe(F.col("b._host"))) & (
        F.col("r._text_key") == F.col("b._text_key")
    )
    depleted = F.col("b._text_key").isNotNull()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return (
        rows.alias("r")
        .join(bad.alias("b"), on, "left")
        .select(
            "r.doc_id",
            *[f"r.{c}" for c in counts],
            depleted.alias("depleted"),
            (~F.col("base_failed") & ~depleted).alias("kept"),
        )
    )
