"""Fusion of verification scores; a null score is a component that was not available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the three components, and the factor of speech below / from the bound on.
WEIGHTS = (0.4, 0.3, 0.3)
SPEECH_BOUND = 0.6
LOW_FACTOR = 0.1


def activity_factor(ratio: Column) -> Column:
    """1 for spans with enough speech, a tenth otherwise."""
    return F.when(ratio >= SPEECH_BOUND, 1.0).otherwise(LOW_FACTOR)


def weighted(scores: list[Column], factor: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """Weighted mean of the available scores times the factor; 0 if none is available."""
    top = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    bottom = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    return F.when(bottom > 0, top / bottom * factor).otherwise(0.0)


def positive_mean(scores: list[Column], factor: Column) -> Column:
    """Mean of the scores above 0 times the factor; 0 if there is none."""
    kept = F.filter(F.array(*scores), lambda x: x > 0)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept) * factor).otherwise(0.0)


def split_accepted(rows: DataFrame, score: str, bound: float) -> DataFrame:
    """Adds ``accepted``: the score reaches the bound; a null score does not."""
    return rows.withColumn("accepted", F.coalesce(F.col(score) >= bound, F.lit(False)))


def split_clean(rows: DataFrame, score: str, bound: float) -> DataFrame:
    """Adds ``clean``; a missing score counts as 0."""
    return rows.withColumn("clean", F.coalesce(F.col(score), F.lit(0.0)) >= bound)


def acceptance_counts(rows: DataFrame) -> DataFrame:
    """One row: how many are accepted and rejected."""
    return rows.agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_rejected"))


def recombined(split: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Clips that were clean from the start, and the cleaned versions of the others, with ``origin``; columns are those of `cleaned`."""
    first = split.filter("clean").select(*cleaned.columns).withColumn("origin", F.lit("as_is"))
    return first.unionByName(cleaned.withColumn("origin", F.lit("cleaned")))
