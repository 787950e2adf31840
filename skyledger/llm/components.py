"""Connected components of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller and itself) to its least."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    both = both.distinct()
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v); a component is its least node.

    Rounds of large stars and small stars until nothing changes, each written to the
    shared folder. A node's neighbours are never gathered: their least is a sum that
    starts in the tasks, and a hub's links are rows that Spark can split.
    """
    edges = written(links.filter("u <> v").select("u", "v").distinct(), "links")
    check = edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count("*")).first()
    while True:
        edges = written(_star(written(_star(edges, True), "large-star"), False), "small-star")
        now = edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count("*")).first()
        if now == check:
            break
        check = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
