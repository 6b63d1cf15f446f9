"""Quality gate: every reason a clip is rejected for, at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.frames import CLIPPED


@dataclass(frozen=True)
class Thresholds:
    """Bounds of the gate; a null bound is not checked."""

    min_us: int = 1_000_000
    max_us: int = 15_000_000
    need_transcript: bool = True
    need_validated: bool = True
    need_verified: bool = True
    reject_clipping: bool = True
    max_true_peak_db: float | None = -1.0
    min_align: float = 0.0
    min_quality: float | None = None


def normalized(transcript: Column, language: Column) -> Column:
    """The transcript as it is read aloud, by language."""
    arabic = tx.is_arabic(language)
    return F.when(arabic, tx.normalize_ar(transcript, arabic)).otherwise(tx.normalize_en(transcript))


@dataclass(frozen=True)
class Check:
    """A check of a user's own: the clips it rejects, and the value that is reported."""

    reason: str
    rejects: Column
    value: Column | None = None


def reasons(columns: list[str], limits: Thresholds = Thresholds(), more: Sequence[Check] = ()) -> Column:
    """Map from reason to value (1 where there is no figure); empty if the clip passes.

    Checks that need a column the table does not have are left out: ``peak``,
    ``true_peak_db``, ``n_samples``, ``align_score``, ``quality_score``, ``has_audio``.
    `more` are checks beside the built-in ones; a null verdict passes.
    """
    found: list[tuple[str, Column, Column]] = []

    def check(name: str, on: bool, when: Column, value: Column | None = None) -> None:
        if on:
            found.append((name, when, F.lit(1.0) if value is None else value))

    seconds = F.round(F.col("dur_us") / 1_000_000, 3)
    has = lambda c: c in columns
    # blank after normalising, without normalising
    check("empty_transcript", limits.need_transcript, tx.is_blank(F.col("transcript"), tx.is_arabic(F.col("language"))))
    check("duration_too_short", True, F.col("dur_us") < limits.min_us, seconds)
    check("duration_too_long", True, F.col("dur_us") > limits.max_us, seconds)
    check("not_silence_validated", limits.need_validated, ~F.coalesce("silence_validated", F.lit(False)))
    check("not_verified", limits.need_verified, ~F.coalesce("verified", F.lit(False)))
    clipped = limits.reject_clipping and has("peak")
    if has("peak"):
        check("clipping", clipped, F.col("peak") >= CLIPPED, F.round(20 * F.log10(F.col("peak") + 1e-10), 3))
    if has("true_peak_db") and limits.max_true_peak_db is not None:
        over = F.col("true_peak_db") > limits.max_true_peak_db
        check("true_peak_exceeds", True, over & ~(F.col("peak") >= CLIPPED) if clipped else over, F.round("true_peak_db", 3))
    if has("n_samples"):
        check("empty_audio", True, F.col("n_samples") == 0)
    if has("align_score"):
        check("align_score_low", limits.min_align > 0, F.col("align_score") < limits.min_align, F.round("align_score", 4))
    if has("quality_score") and limits.min_quality is not None:
        check("dnsmos_below", True, F.col("quality_score") < limits.min_quality, F.round("quality_score", 3))
    for own in more:
        check(own.reason, True, own.rejects, own.value)
    entries = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("key"), value.cast("double").alias("value"))) for name, when, value in found]
    every = F.map_from_entries(F.array_compact(F.array(*entries)))
    if not has("has_audio"):
        return every
    return F.when(F.col("has_audio"), every).otherwise(F.create_map(F.lit("no_audio"), F.lit(1.0)))


def judged(clips: DataFrame, limits: Thresholds = Thresholds(), more: Sequence[Check] = ()) -> DataFrame:
    """Adds ``reasons`` and ``accepted``."""
    return clips.withColumn("reasons", reasons(clips.columns, limits, more)).withColumn("accepted", F.size("reasons") == 0)


def gate(clips: DataFrame, limits: Thresholds = Thresholds(), more: Sequence[Check] = ()) -> DataFrame:
    """Adds ``reasons``, ``accepted`` and ``normalized``.

    No check reads the normalised text, so a filter on ``accepted`` comes before it is made.
    """
    return judged(clips, limits, more).withColumn("normalized", normalized(F.col("transcript"), F.col("language")))


def reason_counts(gated: DataFrame) -> DataFrame:
    """``reason, n``: how many clips each reason rejects."""
    return gated.select(F.explode(F.map_keys("reasons")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
