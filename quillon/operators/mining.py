"""Mining reference clips: scored windows and a diverse choice of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import intervals as iv
from quillon.plans.shared import materialised


def windows(speech: DataFrame, keys: list[str], gap_us: int, most_us: int, least_us: int) -> DataFrame:
    """Tiles of the joined speech regions, with the region's length ``region_us``."""
    regions = iv.union(speech, keys, gap_us).select(*keys, "s_us", "e_us", (F.col("e_us") - F.col("s_us")).alias("region_us"))
    return iv.tiles(regions, [*keys, "region_us"], most_us, least_us).drop("tile")


def scored(found: DataFrame, speech: DataFrame, keys: list[str], least_density: float) -> DataFrame:
    """Windows dense enough, with ``density`` and ``score`` (length up to a minute plus 25 times the density)."""
    voiced = iv.overlap_of_windows(found, speech, keys)
    dense = voiced.withColumn("density", F.col("voiced_us") / (F.col("e_us") - F.col("s_us"))).filter(F.col("density") >= least_density)
    return dense.withColumn("score", F.least(F.col("region_us") / 1_000_000, F.lit(60.0)) + F.col("density") * 25)


def longest_first(spans: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    """Spans of each key by falling length, earlier ones first on ties; `limit` 0 takes all."""
    order = Window.partitionBy(*keys).orderBy((F.col("s_us") - F.col("e_us")), "s_us")
    ranked = spans.withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= limit) if limit else ranked


def spread_us(duration_us: int, limit: int) -> int:
    """How far apart picks should be: 20 s, or half an even share of the recording."""
    return max(20_000_000, round(duration_us / (2 * limit)))


def diverse(found: DataFrame, keys: list[str], limit: int, apart_us: int) -> DataFrame:
    """At most `limit` windows of each key, best first, with centres `apart_us` apart; then filled up with the best left.

    Ties go to the earlier and then the shorter window; repeated windows count once.
    There is a round for each pick: the best window that no earlier pick is near is
    taken by a combined aggregate, and picks meet the windows near them by key and
    time bucket, so a busy recording is spread over its buckets.  Rounds end early
    when no key has a pick left.
    """
    span = max(1, 2 * apart_us)
    entry = F.struct((-F.col("score")).alias("k"), "s_us", "e_us")
    centre = F.col("s_us") + F.col("e_us")
    base = materialised(found.select(*keys, "s_us", "e_us", "score").distinct().select(*keys, entry.alias("w"), centre.alias("c"), F.floor(centre / span).alias("bucket")))
    same = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]) & (F.col("b.bucket") == F.col("p.bucket"))
    rows, left, picks = base.alias("b"), base, base.limit(0).select(*keys, "w", "c", "bucket")
    for nth in range(limit):
        best = left.groupBy(*keys).agg(F.min("w").alias("w")).withColumn("c", F.col("w.s_us") + F.col("w.e_us"))
        now = materialised(best.withColumn("bucket", F.floor(F.col("c") / span)))
        picks = picks.unionByName(now) if nth else now
        if now.isEmpty():
            break
        around = picks.select(*keys, "w", "c", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket")).alias("p")
        near = (F.abs(F.col("b.c") - F.col("p.c")) < 2 * apart_us) | (F.col("b.w") == F.col("p.w"))
        left = rows.join(around, same & near, "left_anti")
    others = rows.join(picks.alias("p"), same & (F.col("b.w") == F.col("p.w")), "left_anti")
    best = others.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("w"))).filter(F.col("place") <= limit).select(*keys, "w", F.lit(1).alias("late"))
    both = picks.select(*keys, "w", F.lit(0).alias("late")).unionByName(best)
    full = both.withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy("late", "w")) - 1).filter(F.col("pick") < limit)
    return full.select(*keys, "pick", "w.s_us", "w.e_us", (-F.col("w.k")).alias("score"))


def silence_rows(log: DataFrame, key: str, text: str) -> DataFrame:
    """``key, s_us, e_us`` from a detector's log (fixed value: its words); the last silence may be open (null end)."""
    seconds = lambda word: F.regexp_extract_all(text, F.lit(rf"{word}:\s*(-?\d+(?:\.\d+)?)"), F.lit(1))
    pairs = F.arrays_zip(seconds("silence_start").alias("s"), seconds("silence_end").alias("e"))
    us = lambda c: (F.col(c).try_cast("decimal(18,6)") * 1_000_000).cast("long")
    return log.select(key, F.explode(pairs).alias("p")).filter("p.s is not null").select(key, us("p.s").alias("s_us"), us("p.e").alias("e_us"))


def duration_us(text: Column) -> Column:
    """Length from a ``Duration: H:M:S`` line (fixed value: a probe's form); null if there is none, or if it is n/a."""
    part = lambda i: F.regexp_extract(text, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("decimal(18,6)")
    return ((part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000).cast("long")
