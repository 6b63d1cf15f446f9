"""Reference clips of targets: decoded, one channel, at the models' rate; what cannot be used is named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import audio
from quillon.sources import sound_files as sf

#: Fixed value: the rate that models of voices expect.
RATE = 16_000


def _name(path: str = "path"):
    return F.substring_index(path, "/", -1)


def checked(spark: SparkSession, references: DataFrame, folder: str) -> DataFrame:
    """``target, clip_no, name, rate, frames, error`` of every reference, from headers alone.

    ``references`` has ``target, clip_no, name``, the name being that of a sound file
    below `folder`.  Errors: ``missing``, ``unreadable`` (no sound that can be read),
    ``empty`` (no samples); null if the clip can be used.  If several files
    have the name, the first path counts.
    """
    sf.install(spark)
    heads = spark.read.format("quillon_sound").option("read", "headers").load(folder)
    files = heads.groupBy(_name().alias("name")).agg(F.min_by(F.struct("path", "rate", "frames"), "path").alias("f"))
    error = F.when(F.col("f").isNull(), "missing").when(F.col("f.rate").isNull(), "unreadable").when(F.col("f.frames") == 0, "empty")
    return references.select("target", "clip_no", "name").join(files, "name", "left").select("target", "clip_no", "name", "f.path", "f.rate", "f.frames", error.alias("error"))


def required(status: DataFrame) -> DataFrame:
    """The references that can be used; raises if one cannot, naming some of those that cannot."""
    bad = status.filter("error is not null")
    some = bad.orderBy("target", "clip_no").select("target", "clip_no", "name", "error").limit(5).collect()
    if some:
        named = "; ".join(f"{r.target}/{r.clip_no} {r.name}: {r.error}" for r in some)
        raise RuntimeError(f"{bad.count()} reference clips cannot be used ({named})")
    return status


def prepared(spark: SparkSession, references: DataFrame, folder: str, rate: int = RATE, strict: bool = True) -> DataFrame:
    """``target, clip_no, pos, x``: the samples of every reference at `rate`, channels averaged.

    A reference that is missing, unreadable or empty raises; with ``strict=False`` it
    has no samples.  Files are read in byte ranges, so a long one is several tasks' work.
    """
    status = checked(spark, references, folder)
    usable = (required(status) if strict else status).filter("error is null")
    blocks = spark.read.format("quillon_sound").load(folder).select("path", "begin", "samples")
    heard = usable.select(F.struct("target", "clip_no").alias("ref"), "path", "rate").join(blocks, "path")
    samples = heard.select("ref", "rate", "begin", F.posexplode("samples").alias("i", "x")).select("ref", "rate", (F.col("begin") + F.col("i")).alias("pos"), F.col("x").cast("double").alias("x"))
    return audio.resampled(samples, "ref", "rate", rate).select("ref.target", "ref.clip_no", "pos", "x")


def waves(prepared_samples: DataFrame) -> DataFrame:
    """``target, clip_no, samples`` of prepared clips, each in one row: what a model takes."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return prepared_samples.groupBy("target", "clip_no").agg(F.transform(ordered, lambda p: p["x"]).alias("samples"))
