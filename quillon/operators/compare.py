"""Comparing two runs: accepted sets, transcripts, scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillon.functions import text as tx


def jaccard(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``keys, n_both, n_any, jaccard`` of the items of two runs; an item counts once in a run."""
    left = a.select(*keys, item).distinct().withColumn("in_a", F.lit(1))
    right = b.select(*keys, item).distinct().withColumn("in_b", F.lit(1))
    met = left.join(right, [*keys, item], "full_outer")
    counted = met.groupBy(*keys).agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"), F.count("*").alias("n_any"))
    return counted.withColumn("jaccard", F.when(F.col("n_any") > 0, F.col("n_both") / F.col("n_any")).otherwise(1.0))


def _as_characters(tokens: Column, vocabulary: Column) -> Column:
    """Each token as the character of its place in the vocabulary, from U+0100 on."""
    code = lambda t: F.lpad(F.hex(F.array_position(vocabulary, t) + 255), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(tokens, code), "")), "UTF-16BE")


#: Different tokens of a pair that have characters of their own below the surrogates.
CHARACTERS = 55_040


def edits(reference: list, hypothesis: list) -> int:
    """Edit distance of two sequences, a row of the table at a time as bits of one integer.

    A bit of `up` (or `down`) says that a cell is one more (or less) than the one
    before it in its column; adding carries matches along the row.
    """
    if not reference:
        return len(hypothesis)
    where: dict = {}
    for i, token in enumerate(reference):
        where[token] = where.get(token, 0) | 1 << i
    every, top = (1 << len(reference)) - 1, 1 << (len(reference) - 1)
    up, down, distance = every, 0, len(reference)
    for token in hypothesis:
        match = where.get(token, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | ~(diagonal | up) & every, up & diagonal
        distance += (right & top > 0) - (left & top > 0)
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | ~(diagonal | right) & every, right & diagonal
    return distance


@F.arrow_udf(IntegerType())
def _edits_of_many(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Edit distances of lists of words; null where there is none to compute.  Words become Python's a pair at a time, not a batch."""
    return pa.array((edits(r.as_py(), h.as_py()) if r.is_valid else None for r, h in zip(reference, hypothesis, strict=True)), pa.int32())


def word_errors(rows: DataFrame, reference: str, hypothesis: str, most: int = CHARACTERS) -> DataFrame:
    """Adds ``wer``: word edits over reference words.

    Tokens become characters of one string, so the built-in edit distance counts
    words.  Pairs with more than `most` different tokens, which there are no
    characters for, are compared bit by bit in an Arrow function, to the same number.
    """
    pair = rows.withColumn("_r", tx.words(F.col(reference))).withColumn("_h", tx.words(F.col(hypothesis)))
    pair = pair.withColumn("_v", F.array_union("_r", "_h"))
    large = F.size("_v") > most
    pair = pair.withColumn("_many", _edits_of_many(F.when(large, F.col("_r")), F.when(large, F.col("_h"))))
    few = F.when(~large, F.levenshtein(_as_characters(F.col("_r"), F.col("_v")), _as_characters(F.col("_h"), F.col("_v"))))
    wer = F.when(F.size("_r") == 0, F.when(F.size("_h") == 0, 0.0).otherwise(1.0)).otherwise(F.coalesce(few, "_many") / F.size("_r"))
    return pair.withColumn("wer", wer).drop("_r", "_h", "_v", "_many")


def score_delta(a: DataFrame, b: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """``keys, delta``: greatest difference of scores; infinite if an item is on one side only."""
    left, right = a.select(*keys, item, F.col(score).alias("score_a")), b.select(*keys, item, F.col(score).alias("score_b"))
    met = left.join(right, [*keys, item], "full_outer")
    delta = F.when(F.col("score_a").isNull() | F.col("score_b").isNull(), F.lit(float("inf"))).otherwise(F.abs(F.col("score_a") - F.col("score_b")))
    return met.groupBy(*keys).agg(F.max(delta).alias("delta"))


def verdict(jaccards: DataFrame, deltas: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the three measures; ``identical`` if nothing differs."""
    worst = errors.groupBy(*keys).agg(F.max("wer").alias("wer"))
    met = jaccards.select(*keys, "jaccard").join(deltas, keys, "full_outer").join(worst, keys, "full_outer")
    whole = {"jaccard": F.coalesce("jaccard", F.lit(1.0)), "delta": F.coalesce("delta", F.lit(0.0)), "wer": F.coalesce("wer", F.lit(0.0))}
    return met.withColumns(whole).withColumn("identical", (F.col("jaccard") == 1) & (F.col("delta") == 0) & (F.col("wer") == 0))
