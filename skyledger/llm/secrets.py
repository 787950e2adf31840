"""Secret scans with a ledger of blobs already scanned.

Every version of a file is a row (path, text). Its content address, the SHA-256 of its
text, names its blob. The ledger is a Parquet folder with a row for each blob and run:
the rules, each with its version, that were applied, and the spans they found, each with
its rule's version: what an older version found counts no more. A scan
reads only the text of one path for each blob that some current rule version has not
seen, applies just those rules, appends to the ledger in one write, and joins what the
ledger knows of each blob back to all its paths. Repeating a scan that was lost half-way
adds nothing twice, as spans are united by blob.

Null texts are scanned as empty ones, null paths and repeated rows keep their rows, and
an empty table gives an empty result. A blob with a third of all paths is one row when
it is scanned; joined back, its paths are rows of ids that Spark can split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.bitmap import bit_map, of_map
from skyledger.llm.store import written


@dataclass(frozen=True)
class Rule:
    """A pattern, of which matches with a short group or match are dropped.

    ``hints``: texts, in lower case, of which a text has at least one if the pattern
    matches in it; none means every text is searched.
    """

    pattern: str
    least: int = 0
    group: int = 0
    hints: Sequence[str] = ()
    version: int = 1
    flags: int = re.ASCII
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern, self.flags))

    def spans(self, text: str, lower: str) -> Iterator[tuple[int, int]]:
        if self.hints and not any(hint in lower for hint in self.hints):
            return
        for match in self.compiled.finditer(text):
            start, end = match.span(self.group)
            if end - start >= self.least:
                yield match.span()


# The base rules, in the order in which spans of one start are listed.
BASE_RULES = {
    "assign": Rule(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
        hints=("passw", "secret", "token", "api"),
        flags=re.ASCII | re.IGNORECASE,
    ),
    "access": Rule(r"AKIA[A-Z0-9]+", least=20, hints=("akia",)),
    # A run of 24 or more is the whole run: the same as all runs without the short ones.
    "hex": Rule(r"[0-9a-f]{24,}"),
}
RULES = {
    **BASE_RULES,
    "private_key": Rule(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("private key",)),
    "github": Rule(r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,}", hints=("gh",)),
    "jwt": Rule(
        r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        hints=("eyj",),
    ),
}

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = "blob binary, rules array<string>, spans array<struct<kind:string,version:int,start:int,end:int>>"
#: Blobs a task remembers to have scanned.
_SCANNED = 100_000


def spans_of(text: str, rules: Mapping[str, Rule]) -> list[dict]:
    """All spans of ``text`` in code points, end exclusive."""
    lower = text.lower()
    return [
        {"kind": kind, "version": rule.version, "start": start, "end": end}
        for kind, rule in rules.items()
        for start, end in rule.spans(text, lower)
    ]


def blob_of(text) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class Ledger:
    """Blobs scanned so far, in ``folder``; a folder that is not there yet is empty."""

    def __init__(self, spark: SparkSession, folder: str, rules: Mapping[str, Rule] = RULES) -> None:
        self.spark, self.folder, self.rules = spark, folder, dict(rules)

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
        """(path, spans) for every row of ``versions``, scanning what is new in it."""
        rows = versions.select(F.col(path).alias("path"), F.col(text).alias("text"))
        paths = written(rows.select("path", blob_of("text").alias("blob")), "blob-paths")
        self._scan_unseen(rows, paths)
        return paths.join(self.findings(), "blob", "left").select(
            "path", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
        )

    def _names(self) -> dict[str, str]:
        return {f"{kind}:{rule.version}": kind for kind, rule in self.rules.items()}

    def _scan_unseen(self, rows: DataFrame, paths: DataFrame) -> None:
        current = F.array(*map(F.lit, self._names()))
        seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = (
            paths.groupBy("blob")
            .agg(F.min("path").alias("path"))
            .join(seen, "blob", "left")
            .select("blob", "path", todo.alias("rules"))
            .filter(F.size("rules") > 0)
        )
        # One path of each blob is read; the side that is hashed has one row per blob.
        on = (F.col("t.blob") == F.col("u.blob")) & F.col("t.path").eqNullSafe(F.col("u.path"))
        texts = (
            rows.withColumn("blob", blob_of("text"))
            .alias("t")
            .join(unseen.alias("u").hint("shuffle_hash"), on)
            .select("t.blob", "t.text", "u.rules")
        )
        names, rules = self._names(), self.rules

        span = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[bytes] = set()  # rows with equal path and text meet here
            for batch in batches:
                own, found = [], []
                columns = (batch.column(c).to_pylist() for c in ("blob", "text", "rules"))
                for i, (blob, text, todo) in enumerate(zip(*columns, strict=True)):
                    if blob not in done:
                        if len(done) < _SCANNED:
                            done.add(blob)
                        own.append(i)
                        found.append(spans_of(text or "", {names[n]: rules[names[n]] for n in todo}))
                part = batch.select(["blob", "rules"]).take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(span))], ["blob", "rules", "spans"])

        texts.mapInArrow(scan, LEDGER).write.mode("append").parquet(self.folder)

    def findings(self) -> DataFrame:
        """(blob, spans) of each blob in which a current rule, in its current version, found something."""
        current = F.array(*map(F.lit, self._names()))
        kept = F.filter(
            "spans", lambda s: F.array_contains(current, F.concat_ws(":", s["kind"], s["version"].cast("string")))
        )
        plain = F.transform(
            kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        )
        found = self.rows().select("blob", plain.alias("spans")).filter(F.size("spans") > 0)
        # A set: scans that were repeated add nothing to gather.
        found = found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
        return written(found, "blob-findings")


# Names that no table of documents has.
BLOB, FOUND = "__blob", "__blob_spans"


def redacted(docs: DataFrame, ledger: Ledger, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by its kind; a number n_chars counts the new text.

    Rows whose blob cannot be among the findings, by a bit map of these, pass as they
    are, so only the others meet the findings in a join.
    """
    ledger.scan(docs, path, text)
    found = ledger.findings().withColumn("h", F.xxhash64("blob"))
    bits = bit_map(found.select("h"))
    names = docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                content if spans is None else without(content, spans)
                for content, spans in zip(
                    batch.column(text).to_pylist(), batch.column(FOUND).to_pylist(), strict=True
                )
            ]
            out = batch.select(names)
            out = out.set_column(names.index(text), text, pa.array(texts, pa.string()))
            if "n_chars" in names:
                changed = batch.column(FOUND).is_valid()
                length = pc.utf8_length(out.column(text)).cast(out.schema.field("n_chars").type)
                counts = pc.if_else(changed, length, out.column("n_chars"))
                out = out.set_column(names.index("n_chars"), "n_chars", counts)
            yield out

    # Written, so that no task runs the Python workers of both steps at once.
    hashed = F.xxhash64(blob_of(text))
    maybe = written(of_map(docs, hashed, bits, True), "texts-with-secrets")
    spans = found.select(F.col("blob").alias(BLOB), F.col("spans").alias(FOUND))
    joined = maybe.withColumn(BLOB, blob_of(text)).join(spans, BLOB, "left")
    return of_map(docs, hashed, bits, False).unionByName(joined.select(*names, FOUND).mapInArrow(replace, docs.schema))


def without(text: str, spans: list[dict]) -> str:
    """``text`` with each stretch of overlapping spans replaced by the kind of the first."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[{span['kind']}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def digest(found: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, and all spans as text, by start and then by kind."""
    order = F.array(*map(F.lit, rules))
    base = F.array(*map(F.lit, BASE_RULES))
    ordered = F.sort_array(
        F.transform(
            "spans",
            lambda s: F.struct(
                s["start"].alias("start"),
                F.array_position(order, s["kind"]).alias("place"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
    )

    def text(spans: Column) -> Column:
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    found = found.withColumn("_ordered", ordered)

    def count(kind: str) -> Column:
        of_kind = F.filter("_ordered", lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    in_base = F.filter("_ordered", lambda s: F.array_contains(base, s["kind"]))
    return found.select(
        "path",
        *map(count, BASE_RULES),
        F.sha2(text(in_base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("_ordered")).alias("spans"),
    )
