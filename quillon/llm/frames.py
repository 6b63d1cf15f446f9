"""What every corpus operator needs from the session: tables, sizes, checkpoints."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column | str = "text") -> Column:
    """UTF-8 length; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column | str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: the figure that partition counts follow."""
    return docs.select(F.sum(text_bytes(text)).alias("n")).first().n or 0


def parts_for(size: int, each: int, least: int = 8) -> int:
    """How many groups of about `each` bytes cover `size` bytes."""
    return max(least, ceil(size / each))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; on one machine a folder of our own where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jvm.get() if jvm.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/quillon/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage there.

    The rows are written as a Parquet table and read back: any executor can
    read them again after another was lost, and columns stay compressed.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what `cut` wrote for a table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hidden(docs: DataFrame, needed: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """`docs` with names of their own for all columns but the `needed` ones, and what gives the columns back.

    An operator works on the first and selects the second at its end, so that a
    column named like one of the operator's own comes through unchanged.
    """
    needed = set(needed)
    names = [c if c in needed else f"input_{i}_" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


#: A key with so many rows is hot, and so many hot keys there are at most: where there are more rows, a hot key has more of them.
HOT_ROWS, MOST_HOT = 2048, 100_000
#: The rows of a hot key are split over so many tasks, at most.
SALTS = 64


def _hot(counts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The hot keys of ``keys, rows_`` and over how many tasks each is split (``width_``); no more than `MOST_HOT`, so they are broadcast."""
    least = max(HOT_ROWS, -(-total // MOST_HOT))
    width = F.least(F.lit(SALTS), F.ceil(F.col("rows_") * 4 / least)).cast("int")
    return F.broadcast(counts.filter(F.col("rows_") >= least).select(*keys, width.alias("width_")))


def _salted(rows: DataFrame, keys: list[str], by: list[str], hot: DataFrame) -> DataFrame:
    """Adds ``salt_``: a hash of `by` for the rows of a hot key (and of none), else 0."""
    nothing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    width = F.coalesce("width_", F.when(nothing, F.lit(SALTS)).otherwise(1))
    return rows.join(hot, keys, "left").withColumn("salt_", F.pmod(F.xxhash64(*by), width).cast("int")).drop("width_")


def _spread(lookup: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """The rows of a lookup, those of a hot key once for each salt."""
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("width_", F.lit(1)) - 1))
    return lookup.join(hot, keys, "left").withColumn("salt_", salts).drop("width_")


def with_totals(rows: DataFrame, keys: list[str], by: list[str], *totals: Column, having: str | None = None) -> DataFrame:
    """`rows` with the aggregates of their keys; keys that `having` refuses go.

    Aggregates are combined before the shuffle and written, and the rows of a hot
    key are dealt by a hash of `by` over up to `SALTS` tasks, so a key with a third
    of all rows is no one task's work.
    """
    summed = rows.groupBy(*keys).agg(*totals, F.count("*").alias("rows_"))
    kept = cut(summed.filter(having) if having else summed)
    hot = _hot(kept.select(*keys, "rows_"), keys, kept.agg(F.sum("rows_")).first()[0] or 0)
    return _salted(rows, keys, by, hot).join(_spread(kept.drop("rows_"), keys, hot), [*keys, "salt_"]).drop("salt_")


def attached(rows: DataFrame, lookup: DataFrame, keys: list[str], by: list[str], how: str = "inner", base: DataFrame | None = None) -> DataFrame:
    """`rows` with the columns of `lookup`; rows whose key it lacks go, or have nulls with ``how="left"``.

    The rows of a hot key are dealt by a hash of `by` over up to `SALTS` tasks, and
    the key's lookup rows (mostly one) go to each.  Keys are counted in `base`, which is `rows`
    or a written table with the same keys.
    """
    base = rows if base is None else base
    hot = _hot(base.groupBy(*keys).agg(F.count("*").alias("rows_")), keys, base.count())
    return _salted(rows, keys, by, hot).join(_spread(lookup, keys, hot), [*keys, "salt_"], how).drop("salt_")
