"""Near duplicates by tensored MinHash tables, confirmed on whole shingle sets.

A document's set is its distinct five-word shingles (of lower-cased words; a shorter
document has one shingle of all its words). Two documents are linked when at least
0.75 of the union of their sets is shared, and components of links are found.

Table keys come from two small collections of half keys, M each, of R minhashes: table
(i, j) combines half key i of the first with half key j of the second. M * M tables of
2 R minhashes need 2 M R minhashes instead of 2 R M^2. A pair of similarity s
misses all tables with a probability below 2 (1 - s^R)^M: for R = 3, M = 21 under 3e-5
at 0.75, under 6e-7 at 0.8.

1. Documents with equal sets become one class (a 64-bit hash of the set).
2. Only half keys that two classes share can be part of a shared table key; the others
   are dropped before table keys are formed. This loses nothing.
3. Whole sets of the classes in shared tables are fetched by a second reading of the
   texts; a bit map of fixed size keeps out most of the others. A shingle that one class
   alone has cannot be shared. The numbers of its other shingles, in all and in each of
   BUCKETS parts of the hash space, bound what two classes can share, and pairs that
   cannot reach the limit are not formed.
4. The classes of each table are compared with the one of them that has least of its
   own, and the links found give components. Tables that still hold several components
   are then compared across components only, pair by pair. So copies that are linked
   anyway are not paired with each other, however many they are, and no pair that
   shares a table and could be linked goes unproven.
5. A pair is proven on whole sets of 64-bit shingle hashes.

Nothing is capped, and nothing that grows with the documents reaches the driver.

Null and blank texts have no shingles and are linked with nothing. Rows with equal id
are documents of their own; a null id is never a component unless all its members have
none. Repeated rows get equal results. An empty table gives an empty result. Other
columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.bitmap import bit_map, in_map, of_map
from skyledger.llm.components import components
from skyledger.llm.store import written
from skyledger.llm.words import Texts, chunks, mixed, shingles

SIMILAR_PERCENT = 75
R = 3
M = 21
BUCKETS = 128  # a power of two, as hashes are signed in Spark and not in numpy
MANY = 32767

_RANDOM = np.random.default_rng(99)
_FACTORS = _RANDOM.integers(1, 1 << 63, 2 * M * R, dtype=np.uint64) * 2 + 1
_SHIFTS = _RANDOM.integers(0, 1 << 63, 2 * M * R, dtype=np.uint64)
_SALTS = _RANDOM.integers(1, 1 << 63, 2 * M, dtype=np.uint64) * 2 + 1


def distinct_shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    words = texts.words()
    h, at = shingles(words.hashes(), words.at)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(at)))


def set_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set; 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(1)))])
    size = np.diff(at).astype(np.uint64)
    out = mixed((sums[at[1:]] - sums[at[:-1]]) * np.uint64(2) + np.uint64(1) + mixed(size))
    out[size == 0] = 0
    return out.view(np.int64)


def half_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """2 M half keys of each set that is not empty, one row per set: M even ones, M odd ones."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), 2 * M), np.uint64)
    for k in range(2 * M):
        key = np.full(len(starts), _SALTS[k])
        for p in range(k * R, (k + 1) * R):
            hashed = (h * _FACTORS[p] + _SHIFTS[p]) >> np.uint64(16)
            key = mixed(key ^ np.minimum.reduceat(hashed, starts)) if len(starts) else key
        out[:, k] = key & ~np.uint64(1) | np.uint64(k >= M)
    return out.view(np.int64)


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, key, class, size and half keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            h, at = distinct_shingles(texts)
            keys = half_keys(h, at)
            size = np.diff(at)
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, 2 * M, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("key"),
                    pa.array(set_hashes(h, at)),
                    pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel())),
                ],
                ["doc_id", "key", "class", "n", "halves"],
            )

    return docs.mapInArrow(run, "doc_id long, key long, class long, n long, halves array<long>")


def _by(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, which have no nulls, shuffled by ``key``.

    Sums of each key and a join of the rows with these sums share this one exchange, if
    it is the same for both: all columns are used on both sides, the join is an inner one, and the
    filters that Spark would infer for one side alone are there for both.
    """
    return rows.filter(" and ".join(f"{c} is not null" for c in rows.columns)).repartition(key)


def _of_several(rows: DataFrame, key: str) -> DataFrame:
    """The ``rows`` (``key``, class) of each key that several classes have."""
    rows = _by(rows, key)
    several = rows.groupBy(key).agg(F.min("class").alias("_a"), F.max("class").alias("_b")).filter("_a < _b")
    return rows.join(several.select(key), key)


def _table_rows(classes: DataFrame) -> DataFrame:
    """(key, class): each class in each of its tables that can hold another class."""
    halves = classes.select("class", F.explode("halves").alias("half"))
    odd = F.col("half").bitwiseAND(1) == 1
    mine = _of_several(halves, "half").groupBy("class").agg(
        F.collect_list(F.when(~odd, F.col("half"))).alias("a"),
        F.collect_list(F.when(odd, F.col("half"))).alias("b"),
    )
    return (
        mine.select("class", F.explode("a").alias("a"), "b")
        .select("class", "a", F.explode("b").alias("b"))
        .select(F.xxhash64("a", "b").alias("key"), "class")
    )


def _possible(n: str, m: str, shared: Column) -> Column:
    """Whether sets of sizes n and m that share so many at most can be similar."""
    return (100 + SIMILAR_PERCENT) * shared >= SIMILAR_PERCENT * (F.col(n) + F.col(m))


def _least_of_buckets(b: str, c: str) -> Column:
    lower = F.zip_with(b, c, lambda x, y: F.least(x, y).cast("long"))
    return F.aggregate(lower, F.lit(0).cast("long"), lambda total, x: total + x)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, items, b): the sorted shingle hashes of each wanted class, as bytes, and
    how many are in each bucket (null for a set of millions: it has no bound by bucket).
    """
    bits = bit_map(wanted.select(F.col("class").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for _, texts in chunks(batches):
            h, at = distinct_shingles(texts)
            classes = set_hashes(h, at)
            own, items, counts = [], [], []
            for i in np.flatnonzero(in_map(classes, bits) & (np.diff(at) > 0)):
                if (c := int(classes[i])) not in sent:
                    if len(sent) < 100_000:  # copies in one task are sent once
                        sent.add(c)
                    own.append(c)
                    part = h[at[i] : at[i + 1]]
                    items.append(part.tobytes())
                    count = np.bincount(_buckets(part), minlength=BUCKETS)
                    counts.append(count if count.max() <= MANY else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(items, pa.binary()), pa.array(counts, pa.list_(pa.int16()))],
                ["class", "items", "b"],
            )

    found = docs.mapInArrow(run, "class long, items binary, b array<smallint>").join(wanted, "class", "left_semi")
    return written(found.dropDuplicates(["class"]), "shingle-sets")


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """(class, n, most, b): how many shingles some other class of ``sets`` has too.

    In all, and in each bucket. Without the classes that have too many of their own to be similar to any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                items = pa.array(np.frombuffer(batch.column("items")[k].as_buffer(), np.int64))
                own = pa.array(np.full(len(items), batch.column("class")[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([items, own], ["item", "class"])

    own = (
        sets.mapInArrow(run, "item long, class long")
        .groupBy("item")
        .agg(F.count("*").alias("c"), F.min("class").alias("class"))
        .filter("c = 1")
        .groupBy("class", F.expr(f"cast(pmod(item, {BUCKETS}L) as int)").alias("bucket"))
        .agg(F.count("*").alias("c"))
        .groupBy("class")
        .agg(F.sum("c").alias("own"), F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("by"))
    )
    sizes = sets.select("class", F.expr("octet_length(items) div 8").alias("n"), "b").join(own, "class", "left")
    lower = F.transform("b", lambda x, i: (x - F.coalesce(F.try_element_at("by", i), F.lit(0))).cast("smallint"))
    sizes = sizes.withColumns({"most": F.col("n") - F.coalesce("own", F.lit(0)), "b": lower})
    possible = 100 * F.col("most") >= SIMILAR_PERCENT * F.col("n")
    return written(sizes.filter(possible).select("class", "n", "most", "b"), "shared-sizes")


def _proven(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, compared in whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # merges two sorted runs
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * shared >= SIMILAR_PERCENT * (len(both) - shared)
            yield batch.select(["u", "v"]).filter(pa.array(good))

    ends = pairs.select(F.col("u").alias("class")).union(pairs.select("v")).distinct()
    sets = sets.join(ends, "class", "left_semi")
    one = pairs.join(sets.select(F.col("class").alias("u"), F.col("items").alias("a")), "u")
    two = one.join(sets.select(F.col("class").alias("v"), F.col("items").alias("b")), "v")
    return written(two.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "proven-links")


def _pairs_to_least(tables: DataFrame) -> DataFrame:
    """(u, v): the classes of each table with the one that has least of its own."""
    own = ((F.col("n") - F.col("most")) / F.col("n")).alias("own")
    tables = _by(tables, "key")
    least = (
        tables.groupBy("key")
        .agg(F.min(F.struct(own, "class", "n", "most")).alias("x"), F.count("*").alias("_c"))
        .filter("_c > 1")
        .select("key", F.col("x.class").alias("x"), F.col("x.n").alias("m"), F.col("x.most").alias("most_m"))
    )
    pairs = tables.join(least, "key").filter(
        (F.col("class") != F.col("x")) & _possible("n", "m", F.least("most", "most_m"))
    )
    return pairs.select(F.least("x", "class").alias("u"), F.greatest("x", "class").alias("v")).distinct()


def _pairs_across(
    tables: DataFrame, sizes: DataFrame, labels: DataFrame, tried: DataFrame
) -> DataFrame:
    """(u, v): pairs of one table in different components that were not tried before."""
    known = labels.select(F.col("node").alias("class"), "component")
    component = F.coalesce("component", "class").alias("component")
    sizes = written(sizes.join(known, "class", "left").select("class", component, "n", "most", "b"), "component-sizes")
    rows = tables.select("key", "class").join(sizes.select("class", "component"), "class")
    rows = _by(written(rows, "table-components"), "key")
    mixed_keys = (
        rows.groupBy("key")
        .agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.max("class").alias("_c"))
        .filter("_a < _b and _a <= _c")  # always _a <= _c: it keeps class in the exchange of both sides
        .select("key")
    )
    rows = rows.join(mixed_keys, "key").join(sizes.drop("component"), "class")
    rows = written(rows, "mixed-tables")
    # What the members of a component can share at most, each part by itself.
    many = F.lit(MANY).cast("smallint")
    highest = F.array(*[F.max(F.coalesce(F.get("b", F.lit(k)), many)) for k in range(BUCKETS)])
    bounds = sizes.groupBy(F.col("component").alias("other")).agg(
        F.min("n").alias("m"), F.max("most").alias("most_m"), highest.alias("c")
    )
    others = rows.select("key", F.col("component").alias("other")).distinct().join(bounds, "other")
    cheap = F.least("most", "most_m")
    close = F.coalesce(_least_of_buckets("b", "c"), cheap)
    half = rows.join(written(others, "table-others"), "key").filter(
        (F.col("other") > F.col("component")) & _possible("n", "m", cheap) & _possible("n", "m", close)
    )
    half = half.selectExpr("key", "other", "class as x", "n as m", "most as most_m", "b as c")
    whole = half.join(rows.withColumnRenamed("component", "other"), ["key", "other"])
    pairs = whole.filter(_possible("n", "m", cheap) & _possible("n", "m", close)).select(
        F.least("x", "class").alias("u"), F.greatest("x", "class").alias("v")
    )
    return pairs.distinct().join(tried, ["u", "v"], "left_anti")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, component (a class; null without shingles) and its least id.

    ``docs`` has doc_id, key (of the text) and text.
    """
    described = written(_described(docs), "shingle-classes")
    classes = described.filter("n > 0").groupBy("class").agg(
        F.min("doc_id").alias("least_id"), F.first("halves").alias("halves")
    )
    classes = written(classes, "classes")
    tables = written(_of_several(_table_rows(classes), "key"), "tables")
    sets = _sets(docs, tables.select("class").distinct())
    sizes = _shared_sizes(sets)
    tables = tables.select("key", "class").join(sizes.select("class", "n", "most"), "class")
    tables = written(tables, "possible-tables")
    tried = written(_pairs_to_least(tables), "pairs-to-least")
    links = _proven(tried, sets)
    labels = written(components(links), "first-components")
    more = written(_pairs_across(tables, sizes, labels, tried), "pairs-across")
    labels = components(links.union(_proven(more, sets)))
    known = classes.select("class", "least_id").join(
        labels.select(F.col("node").alias("class"), "component"), "class", "left"
    )
    known = written(known.withColumn("component", F.coalesce("component", "class")), "labels")
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = written(known.join(least, "component").select("class", "component", "component_id"), "component-ids")
    return described.select("doc_id", "key", "n", "class").join(ids, "class", "left").drop("class")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable) and kept, for every row."""
    docs = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("key"), F.col(text).alias("text")
    )
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _grouped(docs).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        found.alias("component_id"),
        F.col("doc_id").eqNullSafe(found).alias("kept"),
    )


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: of the least id, then text key.

    Rows without words stay. A null id comes after all others. Rows that have this id
    and text in common are one row after it.
    """
    own_id, own_key = F.col(id_column).cast("long"), text_key(text)
    rows = docs.select(own_id.alias("doc_id"), own_key.alias("key"), F.col(text).alias("text"))
    rows = written(_grouped(rows).filter("n > 0").select("doc_id", "key", "component"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key"))
    winners = written(rows.groupBy("component").agg(first.alias("w")), "group-winners")
    wins = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("key") == F.col("w.key"))
    judged = rows.join(winners, "component").withColumn("wins", wins)
    losers = written(judged.filter("not wins").select("doc_id", "key").distinct(), "losers")
    again = judged.filter("wins").groupBy("doc_id", "key").agg(F.count("*").alias("c")).filter("c > 1")
    again = written(again, "repeated-winners")

    def among(other: DataFrame) -> tuple[DataFrame, Column]:
        named = other.toDF("_lost_id", "_lost_key", *other.columns[2:])
        return named, own_id.eqNullSafe(F.col("_lost_id")) & (own_key == F.col("_lost_key"))

    # Only rows that a bit map does not tell from these meet them in a join.
    these = losers.union(again.select("doc_id", "key"))
    bits = bit_map(these.select(F.xxhash64("doc_id", "key").alias("h")))
    maybe = of_map(docs, F.xxhash64(own_id, own_key), bits, True).join(*among(losers), "left_anti")
    if not again.isEmpty():
        repeated = maybe.join(*among(again), "left_semi").dropDuplicates([id_column, text])
        maybe = maybe.join(*among(again), "left_anti").unionByName(repeated)
    return of_map(docs, F.xxhash64(own_id, own_key), bits, False).unionByName(maybe)
