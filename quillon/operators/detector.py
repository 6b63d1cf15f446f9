"""From a detector's frame probabilities to speech spans.

The probability is smoothed over the last frames and compared with a threshold; a
hysteresis automaton then keeps its state until enough frames of the other kind
stand together.  As runs of equal frames: a run of speech is confirmed when it has
``least_speech`` frames, a run of silence when it has ``least_silence``, and every run
takes the kind of the last confirmed one.  Spans are joined over short silences,
grown, and cut into equal parts where they are too long.

Frames are read in blocks of ``block`` frames (with the last frames of the block
before), so no window runs over all frames of a recording; only the runs, of which
there are far fewer, are put in order by recording.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """What speech detection runs with, in frames of `frame_us`."""

    smooth: int = 5
    threshold: float = 0.4
    least_speech: int = 20
    most_speech: int = 2000
    least_silence: int = 20
    merge_silence: int = 0
    extend: int = 0
    block: int = 30_000
    frame_us: int = 10_000


def smoothed(frames: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """``key, frame, p, block``: the mean of the last `smooth` frames that there are; ``frames`` has ``key, frame, p``."""
    own = F.floor(F.col("frame") / settings.block).cast("long")
    # a frame near a block's end is read by the next block too
    copies = F.when((F.col("frame") + settings.smooth - 1 >= (own + 1) * settings.block), F.array(own, own + 1)).otherwise(F.array(own))
    dealt = frames.select(key, "frame", "p", own.alias("own"), F.explode(copies).alias("block"))
    last = Window.partitionBy(key, "block").orderBy("frame").rangeBetween(-(settings.smooth - 1), 0)
    return dealt.withColumn("p", F.avg("p").over(last)).filter("own = block").drop("own")


def flag_runs(frames: DataFrame, key: str, flag: Column) -> DataFrame:
    """Runs of frames, one after another without a gap, with equal `flag`: ``key, first, past, flag, total, n``.

    ``total`` sums ``p``.  Runs are found in the blocks and joined over their seams.
    """
    within = Window.partitionBy(key, "block").orderBy("frame")
    marked = frames.withColumn("flag", flag)
    same = (F.lag("flag").over(within) == F.col("flag")) & (F.lag("frame").over(within) == F.col("frame") - 1)
    numbered = marked.withColumn("opens", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = [F.min("frame").alias("first"), (F.max("frame") + 1).alias("past")]
    pieces = numbered.groupBy(key, "block", "run").agg(*bounds, F.first("flag").alias("flag"), F.sum("p").alias("total"), F.count("*").alias("n"))
    return _joined(pieces, key, (F.col("flag") == F.col("before_flag")) & (F.col("before_past") == F.col("first")))


def _joined(runs: DataFrame, key: str, goes_on: Column) -> DataFrame:
    """Runs of a recording in order, those that go on from the one before (``before_flag``, ``before_past``) joined with it."""
    along = Window.partitionBy(key).orderBy("first")
    beside = runs.withColumns({"before_flag": F.lag("flag").over(along), "before_past": F.lag("past").over(along)})
    numbered = beside.withColumn("island", F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min("first").alias("first"), F.max("past").alias("past"), F.first("flag").alias("flag"), F.sum("total").alias("total"), F.sum("n").alias("n")).drop("island")


def spans(frames: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """Speech spans: ``key, first, past, part, s_us, e_us, mean_p``.

    ``frames`` has ``key, frame, p`` (one row a frame).  Frames without a probability
    count as silence; a frame that is missing ends the run before it.  ``mean_p`` is
    the mean smoothed probability of the whole span, before it was grown and cut.
    An empty table gives an empty result.
    """
    s = settings
    every = smoothed(frames.withColumn("p", F.coalesce("p", F.lit(0.0))), key, s)
    runs = flag_runs(every, key, F.col("p") >= s.threshold)
    along = Window.partitionBy(key).orderBy("first")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    sure = F.when(F.col("n") >= F.when(F.col("flag"), F.lit(s.least_speech)).otherwise(F.lit(s.least_silence)), F.col("flag"))
    state = F.coalesce(F.last(sure, ignorenulls=True).over(upto), F.lit(False))
    speech = runs.withColumn("flag", state).filter("flag")
    near = F.col("first") - F.col("before_past") <= F.lit(s.merge_silence + 2 * s.extend)
    # runs of one state touch; spans over a short silence, and those that meet when grown, are one
    whole = _joined(speech, key, near)
    length = frames.groupBy(key).agg((F.max("frame") + 1).alias("frames"))
    grown = whole.join(length, key).withColumns({"a": F.greatest(F.col("first") - s.extend, F.lit(0)), "z": F.least(F.col("past") + s.extend, F.col("frames"))})
    parts = grown.withColumn("parts", F.ceil((F.col("z") - F.col("a")) / s.most_speech)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    edge = lambda i: (F.col("a") + F.expr(f"(z - a) * ({i}) div parts")).cast("long")
    cut = parts.select(key, edge("part").alias("first"), edge("part + 1").alias("past"), F.col("part").cast("int").alias("part"), (F.col("total") / F.col("n")).alias("mean_p"))
    return cut.select(key, "first", "past", "part", (F.col("first") * s.frame_us).alias("s_us"), (F.col("past") * s.frame_us).alias("e_us"), "mean_p")
