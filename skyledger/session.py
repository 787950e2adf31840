"""A session with the settings the engine is designed for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS = {
    # Year and month of a zoned timestamp depend on the session's zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Files of a checkpoint go when nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Fewer, larger tasks on a large fact; small inputs are split by core count.
    "spark.sql.files.maxPartitionBytes": "512m",
    # Joins are planned without hints: sizes seen at run time decide what is
    # broadcast, and partitions of a hot key are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128m",
    # Jobs that a refresh or a report submits together share the cores.
    "spark.scheduler.mode": "FAIR",
    # Hash instead of sort where every build partition turned out this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


def build_session(
    app_name: str = "skyledger", settings: Mapping[str, str] | None = None
) -> SparkSession:
    """Get or create a session; ``settings`` (Spark properties) override the defaults."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
