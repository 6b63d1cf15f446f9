"""Materialising a result in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``, or in the context's checkpoint folder; on one machine in a folder of our own where neither is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = given.get() if given.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{where}/quillon/{kind}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """The same rows, written once and read back."""
    path = shared_path(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A join key with so many rows is split over `SPLITS` tasks; no more than `MOST_SPLIT` keys are.
SPLIT_ROWS, SPLITS, MOST_SPLIT = 10_000, 64, 10_000


def split_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int | None = None, how: str = "inner") -> DataFrame:
    """Equi join (inner or left) on `key` in which the rows of a hot key are dealt over several tasks.

    Keys with `rows` or more rows on the left (with more, where that would be over
    `MOST_SPLIT` keys) have their left rows dealt by a hash of the column `by`, and
    their right rows copied to each of those tasks.  The hot keys are broadcast;
    their number is bounded.  Rows without a key go, or with ``how="left"`` are dealt
    over `SPLITS` tasks and meet nothing.
    """
    counts = materialised(left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_")))
    least = max(SPLIT_ROWS if rows is None else rows, (counts.agg(F.sum("rows_")).first()[0] or 0) // MOST_SPLIT)
    hot = F.broadcast(counts.filter(F.col("rows_") >= least).select(key, F.lit(SPLITS).alias("width_")))
    width = F.coalesce("width_", F.when(F.col(key).isNull(), F.lit(SPLITS)).otherwise(1))
    dealt = left.join(hot, key, "left").withColumn("salt_", F.pmod(F.xxhash64(by), width)).drop("width_")
    copied = right.filter(F.col(key).isNotNull()).join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), width.cast("long") - 1))).drop("width_")
    return dealt.join(copied, [key, "salt_"], how).drop("salt_")
