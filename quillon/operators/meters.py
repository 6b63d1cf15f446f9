"""Loudness and true peak of recordings, measured over blocks of samples.

Blocks are rows ``key, block, samples`` (mono, numbered from 0 without gaps); no
task holds more than a block of a recording.

* **Loudness.** The weighting filter is a recursion, so a block's output needs the
  state that the block before it leaves.  A block maps the state it is given to the
  one it leaves by an affine map; its matrix follows from the block's length, its
  offset is what the block leaves of silence.  The maps of a recording (a few numbers
  for each block) are composed in order, and a second pass filters every block from
  the state it is really given.  Energies are summed by tenths of a second, four of
  which make a gating block.
* **True peak.** Three phases between the samples are interpolated.  A block finds
  the peaks whose neighbours it holds; those around a seam are found from the edges
  of both blocks, so samples stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public loudness recommendation (ITU-R BS.1770): shelf and high-pass,
#: absolute gate, relative gate, offset.
SHELF = (1681.974450955533, 3.999843853973347, 0.7071752369554196)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)
ABSOLUTE_GATE, RELATIVE_GATE, OFFSET = -70.0, -10.0, -0.691
#: Samples on each side that an interpolated one is made of.
HALF = 24
PHASES = 4
#: The peak (dB) of a recording without samples.
EMPTY_PEAK_DB = -200.0
#: Samples filtered at once by matrices.
STEP = 64


def weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two second-order sections ``(b, a)`` of the weighting filter at a rate."""
    f, gain, q = SHELF
    k, high = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    middle = high**0.4996667741545416
    scale = 1 + k / q + k * k
    shelf = (np.array([high + middle * k / q + k * k, 2 * (k * k - high), high - middle * k / q + k * k]) / scale, np.array([1, 2 * (k * k - 1) / scale, (1 - k / q + k * k) / scale]))
    f, q = HIGH_PASS
    k = np.tan(np.pi * f / rate)
    scale = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / scale, (1 - k / q + k * k) / scale]))]


class Filter:
    """The weighting filter with a state of four numbers, `STEP` samples at a time."""

    def __init__(self, rate: int) -> None:
        self.sections = weighting(rate)
        unit = np.eye(4)
        # how state and input become state and output, one sample at a time
        self.a = np.stack([self._sample(unit[i], 0.0)[0] for i in range(4)], axis=1)
        self.b, self.d = self._sample(np.zeros(4), 1.0)
        self.c = np.array([self._sample(unit[i], 0.0)[1] for i in range(4)])
        powers = [np.eye(4)]
        for _ in range(STEP):
            powers.append(powers[-1] @ self.a)
        self.leap = powers[STEP]
        self.seen = np.stack([self.c @ powers[i] for i in range(STEP)])
        self.left = np.stack([powers[STEP - 1 - i] @ self.b for i in range(STEP)])
        impulse = [self.d, *(self.c @ powers[i] @ self.b for i in range(STEP - 1))]
        self.heard = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(STEP)] for i in range(STEP)])

    def _sample(self, z: np.ndarray, x: float) -> tuple[np.ndarray, float]:
        out = []
        for i, (b, a) in enumerate(self.sections):
            y = b[0] * x + z[2 * i]
            out += [b[1] * x - a[1] * y + z[2 * i + 1], b[2] * x - a[2] * y]
            x = y
        return np.array(out), x

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output of the samples and the state after them, from the state `z` on."""
        whole = len(x) // STEP * STEP
        rows = x[:whole].reshape(-1, STEP)
        silent, states = rows @ self.left, np.empty((len(rows), 4))
        for i, left in enumerate(silent):
            states[i] = z
            z = self.leap @ z + left
        out = [(rows @ self.heard.T + states @ self.seen.T).ravel()]
        for sample in x[whole:].tolist():
            z, y = self._sample(z, sample)
            out.append(np.array([y]))
        return np.concatenate(out), z

    def passed(self, n: int) -> np.ndarray:
        """What n samples make of a state: the matrix of the affine map."""
        return np.linalg.matrix_power(self.a, n)


@lru_cache(maxsize=8)
def filter_of(rate: int) -> Filter:
    return Filter(rate)


def _leaves(key: str, rate: int):
    """What each block leaves of silence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meter = filter_of(rate)
        for batch in batches:
            samples = [np.asarray(s, float) for s in batch["samples"]]
            left = [meter.run(s, np.zeros(4))[1].tolist() for s in samples]
            yield pd.DataFrame({key: batch[key], "block": batch["block"], "n": [len(s) for s in samples], "left": left})

    return run


def _given(key: str, rate: int):
    """The state each block is given, and how many samples come before it: affine maps composed in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        meter, z, begin, out = filter_of(rate), np.zeros(4), 0, []
        rows = rows.sort_values("block")
        for n, left in zip(rows["n"].tolist(), rows["left"], strict=True):
            out.append((z.tolist(), begin))
            z, begin = meter.passed(n) @ z + np.asarray(left), begin + n
        return pd.DataFrame({key: rows[key], "block": rows["block"], "state": [s for s, _ in out], "begin": [b for _, b in out]})

    return run


def _energies(key: str, rate: int, hop: int):
    """Energy of each tenth of a second that a block holds samples of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meter = filter_of(rate)
        for batch in batches:
            for k, samples, state, begin in zip(batch[key], batch["samples"], batch["state"], batch["begin"], strict=True):
                heard = meter.run(np.asarray(samples, float), np.asarray(state, float))[0]
                if not len(heard):
                    continue
                tenth = np.arange(begin, begin + len(heard)) // hop
                first = np.flatnonzero(np.append(True, tenth[1:] != tenth[:-1]))
                energy = np.add.reduceat(heard * heard, first)
                yield pd.DataFrame({key: [k] * len(first), "tenth": tenth[first], "energy": energy, "n": np.diff(np.append(first, len(heard)))})

    return run


def loudness(blocks: DataFrame, key: str, rate: int) -> DataFrame:
    """``key, lufs``: gated loudness of every recording; null below 0.4 s and where nothing passes the gates.

    ``blocks`` has ``key, block, samples``.  Null samples count as an empty block.
    """
    kind = blocks.schema[key].dataType.simpleString()
    hop = (rate + 5) // 10
    held = blocks.select(key, F.col("block").cast("long").alias("block"), F.coalesce(F.col("samples").cast("array<double>"), F.array().cast("array<double>")).alias("samples"))
    left = held.mapInPandas(_leaves(key, rate), f"{key} {kind}, block long, n long, left array<double>")
    given = left.groupBy(key).applyInPandas(_given(key, rate), f"{key} {kind}, block long, state array<double>, begin long")
    tenths = held.join(given, [key, "block"]).mapInPandas(_energies(key, rate, hop), f"{key} {kind}, tenth long, energy double, n long")
    whole = tenths.groupBy(key, "tenth").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n")).filter(F.col("n") == hop)
    # a tenth is in four gating blocks, which begin at it and at the three before
    gates = whole.select(key, "energy", F.explode(F.sequence(F.greatest(F.lit(0), F.col("tenth") - 3), F.col("tenth"))).alias("gate")).groupBy(key, "gate").agg(F.sum("energy").alias("energy"), F.count("*").alias("n")).filter("n = 4")
    level = lambda mean: F.log10(mean) * 10 + OFFSET
    loud = gates.select(key, (F.col("energy") / (4 * hop)).alias("mean")).filter((F.col("mean") > 0) & (level(F.col("mean")) > ABSOLUTE_GATE))
    bounds = loud.groupBy(key).agg((level(F.avg("mean")) + RELATIVE_GATE).alias("bound"))
    kept = loud.join(bounds, key).filter(level(F.col("mean")) > F.col("bound"))
    return blocks.select(key).distinct().join(kept.groupBy(key).agg(level(F.avg("mean")).alias("lufs")), key, "left")


@lru_cache(maxsize=1)
def interpolation() -> np.ndarray:
    """Weights (phases x 2 * HALF) of the neighbours for the points between two samples: a windowed sinc."""
    at = np.arange(1, PHASES)[:, None] / PHASES - np.arange(-HALF + 1, HALF + 1)[None]
    return np.sinc(at) * np.kaiser(4 * HALF + 1, 8.0)[np.round((at / HALF + 1) * 2 * HALF).astype(int)]


def between(samples: np.ndarray) -> float:
    """The greatest size of the points between samples that have `HALF` neighbours on both sides; 0 if there are none."""
    if len(samples) < 2 * HALF:
        return 0.0
    windows = np.lib.stride_tricks.sliding_window_view(samples, 2 * HALF)
    return max(float(np.abs(windows[i : i + 4096] @ interpolation().T).max()) for i in range(0, len(windows), 4096))


def _peaks(key: str):
    """Each block's own peak and its edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge = 2 * HALF - 1
        for batch in batches:
            samples = [np.asarray(s, float) for s in batch["samples"]]
            peak = [max(float(np.abs(s).max()) if len(s) else 0.0, between(s)) for s in samples]
            yield pd.DataFrame({key: batch[key], "block": batch["block"], "n": [len(s) for s in samples], "peak": peak, "head": [s[:edge].tolist() for s in samples], "tail": [s[-edge:].tolist() if len(s) else [] for s in samples]})

    return run


def true_peak(blocks: DataFrame, key: str) -> DataFrame:
    """``key, true_peak_db``: the greatest size of the wave, between samples too; -200 without samples.

    All blocks but the last must hold at least ``2 * HALF`` samples; otherwise it raises.
    """
    kind = blocks.schema[key].dataType.simpleString()
    held = blocks.select(key, F.col("block").cast("long").alias("block"), F.coalesce(F.col("samples").cast("array<double>"), F.array().cast("array<double>")).alias("samples"))
    found = held.mapInPandas(_peaks(key), f"{key} {kind}, block long, n long, peak double, head array<double>, tail array<double>")
    # a block's tail is read by its neighbour, and its own ends are silence if it has none
    rows = found.select(key, "n", "peak", F.explode(F.array(F.struct(F.col("block").alias("seam"), F.col("head").alias("after"), F.lit(None).cast("array<double>").alias("before")), F.struct((F.col("block") + 1).alias("seam"), F.lit(None).cast("array<double>").alias("after"), F.col("tail").alias("before")))).alias("x"))
    silence = F.array_repeat(F.lit(0.0), 2 * HALF - 1)
    side = lambda c: F.max(F.col(f"x.{c}"))
    seams = rows.groupBy(key, F.col("x.seam").alias("seam")).agg(F.max("peak").alias("peak"), side("before").alias("before"), side("after").alias("after"))
    short = F.when((F.size("before") < 2 * HALF - 1) & (F.size("after") > 0), F.raise_error(F.lit("a block that is not the last one is too short"))).otherwise(F.lit(0.0))
    joined = seams.select(key, "peak", short.cast("double").alias("fine"), F.concat(F.coalesce("before", silence), F.coalesce("after", silence), F.when(F.size("after") < 2 * HALF - 1, silence).otherwise(F.array().cast("array<double>"))).alias("wave"))

    @F.pandas_udf("double")
    def seam_peak(waves: pd.Series) -> pd.Series:
        return waves.map(lambda w: between(np.asarray(w, float)))

    top = joined.groupBy(key).agg(F.max(F.greatest("peak", "fine", seam_peak("wave"))).alias("peak"), F.max("peak").alias("sample_peak"))
    sized = found.groupBy(key).agg(F.sum("n").alias("n"))
    return top.join(sized, key).select(key, F.when(F.col("n") > 0, F.log10(F.col("peak") + 1e-10) * 20).otherwise(EMPTY_PEAK_DB).alias("true_peak_db"))


def measured(blocks: DataFrame, key: str, rate: int) -> DataFrame:
    """``key, lufs, true_peak_db`` of every recording."""
    return loudness(blocks, key, rate).join(true_peak(blocks, key), key, "left")


def in_blocks(samples: DataFrame, key: str, size: int = 1 << 16) -> DataFrame:
    """Rows ``key, pos, x`` as blocks of `size` samples."""
    block = F.floor(F.col("pos") / size).cast("long").alias("block")
    return samples.groupBy(key, block).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("samples"))
