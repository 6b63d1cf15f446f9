"""Incremental runs: job keys, pending work, upserts, logs where the last line counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Jobs that the manifest does not name as done."""
    return jobs.join(manifest.filter("status = 'done'").select("job_key"), "job_key", "left_anti")


def after_crash(jobs: DataFrame, manifest: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pending jobs without the first of each key, which is taken to have caused the crash."""
    left = pending(jobs, manifest)
    return left.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_nth > 1").drop("_nth")


def last_wins(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key; a missing value is empty."""
    return log.groupBy(key).agg(F.max_by(F.coalesce(value, F.lit("")), order).alias(value))


def upsert(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """The manifest with the rows of the updates in place of its own."""
    return manifest.join(updates.select("job_key"), "job_key", "left_anti").unionByName(updates)
