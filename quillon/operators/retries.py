"""Chunks that a model fails on, tried again in halves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.rules import out_of_memory
from quillon.plans.shared import materialised

#: Fixed value: chunks of at most two of these are not cut further.
FLOOR_US = 15_000_000


def retried_in_halves(chunks: DataFrame, keys: list[str], model: Callable[[DataFrame], DataFrame], floor_us: int = FLOOR_US, most_rounds: int = 40) -> DataFrame:
    """What a model says of every chunk, after halving those it fails on: ``keys, s_us, e_us, attempt, text, skipped``.

    `model` takes ``keys, s_us, e_us`` and adds ``text`` and ``error`` (null where it
    did not fail).  A chunk whose error says that memory ran out is cut into halves
    (the first a millisecond longer), which are tried in the next round; one that is
    no longer than two floors is skipped and its text is empty.  Any other error
    raises.  ``attempt`` counts rounds from 0.  Each round runs on what failed in
    the one before, and its answers are written, so no chunk is tried twice.  After
    `most_rounds` rounds with failures it raises.  An empty table gives an empty result.
    """
    spark = chunks.sparkSession
    pending, answers = chunks.select(*keys, "s_us", "e_us"), []
    length = F.col("e_us") - F.col("s_us")
    for attempt in range(most_rounds + 1):
        tried = materialised(model(pending).select(*keys, "s_us", "e_us", "text", "error"))
        other = tried.filter(F.col("error").isNotNull() & ~out_of_memory(F.lit("runtime"), F.col("error"))).select("error").head(1)
        if other:
            raise RuntimeError(f"a chunk failed: {other[0].error}")
        failed = F.col("error").isNotNull()
        over = failed & (length <= 2 * floor_us)
        done = tried.filter(~failed | over)
        answers.append(done.select(*keys, "s_us", "e_us", F.lit(attempt).alias("attempt"), F.when(over, F.lit("")).otherwise(F.col("text")).alias("text"), over.alias("skipped")))
        again = tried.filter(failed & (length > 2 * floor_us))
        if again.isEmpty():
            break
        if attempt == most_rounds:
            raise RuntimeError(f"chunks still fail after {most_rounds} rounds of halving")
        middle = F.col("s_us") + F.floor(length / 2).cast("long") + 1000
        halves = F.array(F.struct("s_us", middle.alias("e_us")), F.struct(middle.alias("s_us"), "e_us"))
        pending = again.select(*keys, F.explode(halves).alias("half")).select(*keys, "half.*")
    out = answers[0] if answers else spark.createDataFrame([], chunks.schema)
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
