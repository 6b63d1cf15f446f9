"""Frame statistics over samples laid out as rows ``(key, pos, x)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the level formulas.
EPSILON = 1e-10
SILENT_DB = -120.0
CLIPPED = 0.999969


def decibels(level: Column) -> Column:
    """20 log10 of a level, guarded."""
    return F.log10(level + EPSILON) * 20


def frame_levels(samples: DataFrame, key: str, hop: int) -> DataFrame:
    """``key, frame, rms_db``: root mean square of `hop` samples; a short last frame counts as padded with zeros."""
    frames = samples.groupBy(key, F.floor(F.col("pos") / hop).cast("long").alias("frame")).agg(F.sum(F.col("x") * F.col("x")).alias("power"))
    return frames.select(key, "frame", decibels(F.sqrt(F.col("power") / hop + EPSILON)).alias("rms_db"))


def overall_level(samples: DataFrame, key: str) -> DataFrame:
    """``key, level_db``: of the whole signal; the silent level when next to nothing is there."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    return samples.groupBy(key).agg(rms.alias("rms")).select(key, F.when(F.col("rms") > 1e-9, F.log10("rms") * 20).otherwise(SILENT_DB).alias("level_db"))


def peaks(samples: DataFrame, key: str) -> DataFrame:
    """``key, peak_db, clipping``."""
    top = samples.groupBy(key).agg(F.max(F.abs("x")).alias("peak"))
    return top.select(key, decibels(F.col("peak")).alias("peak_db"), (F.col("peak") >= CLIPPED).alias("clipping"))


def envelope(samples: DataFrame, key: str, step: int, stride: int) -> DataFrame:
    """``key, col, peak``: the greatest of every `stride`-th sample of `step` samples."""
    picked = samples.filter(F.col("pos") % step % stride == 0)
    return picked.groupBy(key, F.floor(F.col("pos") / step).cast("long").alias("col")).agg(F.max(F.abs("x")).alias("peak"))


def speech_mask(spans: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """``key, frame, speech`` of every frame; ``spans`` has frame ranges ``first, past``, ``lengths`` has ``n``.

    Edges add up along the frames, so a frame costs the same under many spans.
    """
    cut = spans.join(lengths, key).select(key, F.greatest("first", F.lit(0)).alias("first"), F.least("past", "n").alias("past")).filter("past > first")
    ends = F.array(F.struct(F.col("first").alias("frame"), F.lit(1).alias("d")), F.struct(F.col("past").alias("frame"), F.lit(-1).alias("d")))
    marks = cut.select(key, F.explode(ends).alias("m")).select(key, "m.frame", "m.d").groupBy(key, "frame").agg(F.sum("d").alias("d"))
    frames = lengths.filter("n > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("frame"))
    along = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.join(marks, [key, "frame"], "left").select(key, "frame", (F.coalesce(F.sum("d").over(along), F.lit(0)) > 0).alias("speech"))


def runs(frames: DataFrame, key: str, flag: str) -> DataFrame:
    """Runs of frames where `flag` holds: ``key, first, last, quietest, quietest_db`` (the first of equal minima)."""
    along = Window.partitionBy(key).orderBy("frame")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    turned = frames.withColumn("turn", F.when(F.col(flag) == F.coalesce(F.lag(flag).over(along), ~F.col(flag)), 0).otherwise(1))
    numbered = turned.withColumn("run", F.sum("turn").over(upto)).filter(flag)
    least = F.min(F.struct("rms_db", "frame"))
    return numbered.groupBy(key, "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), least.alias("least")).select(key, "first", "last", F.col("least.frame").alias("quietest"), F.col("least.rms_db").alias("quietest_db"))


def zones(frames: DataFrame, key: str, least_frames: int) -> DataFrame:
    """Cut zones: every run of frames without speech, with ``long_enough``."""
    return runs(frames.withColumn("quiet", ~F.col("speech")), key, "quiet").withColumn("long_enough", F.col("last") - F.col("first") + 1 >= least_frames)


def silence_runs(frames: DataFrame, key: str, below_db: float, least_frames: int) -> DataFrame:
    """Runs that are both quiet and without speech, `least_frames` long or more."""
    quiet = ~F.col("speech") & (F.col("rms_db") <= below_db)
    return runs(frames.withColumn("quiet", quiet), key, "quiet").filter(F.col("last") - F.col("first") + 1 >= least_frames)


def quietest(frames: DataFrame, key: str) -> DataFrame:
    """``key, frame, rms_db`` of the quietest frame, the first of equals."""
    return frames.groupBy(key).agg(F.min(F.struct("rms_db", "frame")).alias("m")).select(key, "m.frame", "m.rms_db")


def loudest(frames: DataFrame, key: str) -> DataFrame:
    """``key, level_db``: the loudest frame."""
    return frames.groupBy(key).agg(F.max("rms_db").alias("level_db"))
