"""Signal arithmetic over columns and sample rows: gain, resampling, mixing, bandwidth, reels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Gain bound (dB), shortest clip that is measured (s), true-peak limit (dBTP),
# share of the Nyquist frequency a full-band recording reaches, and share of energy below the roll-off.
MOST_GAIN_DB = 12.0
MEASURED_US = 400_000
PEAK_LIMIT_DB = -1.0
FULL_BAND = 0.75
ROLLOFF = 0.99


def mono(left: Column, right: Column) -> Column:
    """Mean of two channels, sample by sample."""
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def gain_db(loudness: Column, dur_us: Column, target: float) -> Column:
    """Gain towards the target loudness, bounded; none for short clips or without a measure."""
    wanted = F.least(F.lit(MOST_GAIN_DB), F.greatest(F.lit(-MOST_GAIN_DB), F.lit(target) - loudness))
    usable = (dur_us >= MEASURED_US) & loudness.isNotNull() & ~F.isnan(loudness) & (F.abs(loudness) < float("inf"))
    return F.when(usable, wanted).otherwise(0.0)


def limited_scale(gain: Column, true_peak_db: Column) -> Column:
    """Linear factor of a gain, lowered so that the true peak stays at the limit."""
    over = F.greatest(F.lit(0.0), true_peak_db + gain - PEAK_LIMIT_DB)
    return F.pow(F.lit(10.0), (gain - F.when(gain == 0, 0.0).otherwise(F.coalesce(over, F.lit(0.0)))) / 20)


#: Samples of a recording that one task puts in order.
BLOCK = 1 << 16


def resampled(samples: DataFrame, key: str, source_rate: int | str, rate: int, block: int = BLOCK) -> DataFrame:
    """``key, pos, x`` at another rate by linear interpolation between neighbours (the last sample holds).

    Samples meet in blocks of `block` positions, so a long recording is many tasks'
    work; a first pass gives, in one row a block, the recording's length and the
    sample that follows the block.  Samples without a key go.  `source_rate` is a
    number, or the column that has each recording's own.  At one and the same number
    samples stay as they are.
    """
    if source_rate == rate:
        return samples.filter(F.col(key).isNotNull()).select(key, F.col("pos").cast("long").alias("pos"), "x")
    own = F.lit(source_rate) if isinstance(source_rate, int) else F.col(source_rate)
    blocked = samples.select(key, "pos", "x", own.alias("rate_"), F.floor(F.col("pos") / block).alias("block_"))
    firsts = blocked.groupBy(key, "block_").agg(F.count("*").alias("n_"), F.min_by(F.struct("x"), "pos").alias("first_"), F.min("rate_").alias("rate_"))
    recording = Window.partitionBy(key)
    lookup = firsts.select(key, "block_", "rate_", F.sum("n_").over(recording).alias("n"), F.lead("first_").over(recording.orderBy("block_")).alias("next_"))
    along = Window.partitionBy(key, "block_").orderBy("pos")
    n_out = F.bround(F.col("n").cast("double") * rate / F.col("rate_"), 0).cast("long")
    then = F.coalesce(F.lead(F.struct("x")).over(along), F.col("next_"))["x"]
    rows = blocked.drop("rate_").join(lookup, [key, "block_"]).select(key, "pos", "x", F.coalesce(then, F.col("x")).alias("then"), "n", n_out.alias("n_out"))
    step = F.col("n") / F.col("n_out")
    first, last = F.ceil(F.col("pos") / step), F.ceil((F.col("pos") + 1) / step) - 1
    spread = rows.filter("n_out > 0").withColumn("new", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).filter("new < n_out")
    at = F.col("new") * step - F.col("pos")
    return spread.select(key, F.col("new").alias("pos"), (F.col("x") + (F.col("then") - F.col("x")) * at).alias("x"))


def bandwidth(waves: DataFrame, key: str, rate: int, frame: int = 2048, hop: int = 512) -> DataFrame:
    """``key, rolloff_hz, limited``: the middle of the frames' roll-off frequencies; null without samples.

    ``waves`` has ``samples`` as an array; the transform of a frame has no built-in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = np.hanning(frame + 1)[:-1]
        for batch in batches:
            found = []
            for wave in batch["samples"]:
                x = np.asarray(wave if wave is not None else [], float)
                if not len(x):
                    found.append(None)
                    continue
                x = np.pad(x, frame // 2)
                frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, frame - len(x)))), frame)[::hop]
                power = np.cumsum(np.abs(np.fft.rfft(frames * window, axis=1)), axis=1)
                found.append(float(np.median(np.argmax(power >= ROLLOFF * power[:, -1:], axis=1)) * rate / frame))
            yield pd.DataFrame({key: batch[key], "rolloff_hz": pd.array(found, dtype="Float64")})

    kind = waves.schema[key].dataType.simpleString()
    rows = waves.select(key, "samples").mapInPandas(run, f"`{key}` {kind}, rolloff_hz double")
    return rows.withColumn("limited", F.coalesce(F.col("rolloff_hz") < rate / 2 * FULL_BAND, F.lit(False)))


def reel(clips: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Where each clip begins in the reel: clips in order of their start, a gap between, empty ones left out."""
    order = Window.partitionBy(*keys).orderBy("s_us", "clip_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(order) - 1
    return clips.filter("dur_us > 0").withColumns({"nth": nth, "offset_us": F.coalesce(F.sum("dur_us").over(before), F.lit(0)) + nth.cast("long") * gap_us})


#: Fixed value: the peak (dB) of a clip without samples.
EMPTY_PEAK_DB = -200.0


def peak_db(clips: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """``key, true_peak_db`` of every clip: the sample peak, which stands in where no oversampler measures the true one."""
    top = samples.groupBy(key).agg(F.max(F.abs("x")).alias("peak"))
    return clips.select(key).join(top, key, "left").select(key, F.coalesce(F.log10(F.col("peak") + 1e-10) * 20, F.lit(EMPTY_PEAK_DB)).alias("true_peak_db"))


def exported(samples: DataFrame, meters: DataFrame, key: str, source_rate: int, rate: int, target: float = -23.0) -> DataFrame:
    """``key, pos, pcm``: clips as they are written: resampled, brought to the target loudness last, cut to [-1, 1], in 16 bits.

    ``meters`` has ``lufs`` and ``true_peak_db`` of each clip (a loudness of null keeps its level).
    """
    at_rate = resampled(samples, key, source_rate, rate)
    lengths = at_rate.groupBy(key).agg((F.count("*") * 1_000_000 / rate).alias("dur_us"))
    gain = gain_db(F.col("lufs"), F.col("dur_us"), target)
    scales = lengths.join(meters, key, "left").select(key, limited_scale(gain, F.col("true_peak_db")).alias("scale"))
    level = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x") * F.col("scale")))
    return at_rate.join(scales, key).select(key, "pos", F.bround(level * 32767, 0).cast("int").alias("pcm"))
