"""Interval algebra over rows ``(keys..., s_us, e_us)`` in integer microseconds.

Spans are half-open.  Everything is windows, sweeps of +1/-1 edges and equi joins
on the keys; no operator compares all spans with all spans, and no window runs over
a key's whole time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.arrays import running
from quillon.plans.shared import materialised

GAP_US = 250_000


def positive(spans: DataFrame) -> DataFrame:
    """Spans of some length."""
    return spans.filter("e_us > s_us")


def at_least(spans: DataFrame, least_us: int) -> DataFrame:
    """Spans no shorter than `least_us`."""
    return spans.filter(F.col("e_us") - F.col("s_us") >= least_us)


#: Length of the time buckets that spans are dealt into where they are joined by overlap, and that scans are split into.
BUCKET_US = 300_000_000


def _bucket(us: Column, bucket_us: int) -> Column:
    return F.floor(us / bucket_us).cast("long")


def _carried(buckets: DataFrame, keys: list[str], values: list[str], carry: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """What each bucket is given by those before and after it: ``k_<key>..., k_bucket`` and the columns of `carry`.

    A key's buckets stand in one array in order of time (a few numbers for five
    minutes of a recording: 4 MB for a year); `carry` gives an array for each column.
    """
    line = buckets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", *values))).alias("line"))

    def rows(line: Column) -> Column:
        arrays = carry(line)
        return F.transform(line, lambda x, i: F.struct(x["bucket"].alias("k_bucket"), *[F.get(a, i).alias(c) for c, a in arrays.items()]))

    return line.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.explode(rows(F.col("line"))).alias("one")).select(*[f"k_{k}" for k in keys], "one.*")


def _with_carry(rows: DataFrame, keys: list[str], carried: DataFrame) -> DataFrame:
    """Rows with what their bucket is given; null keys meet each other."""
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    return rows.join(carried, [*same, F.col("bucket") == F.col("k_bucket")]).drop(*[f"k_{k}" for k in keys], "k_bucket")


def union(spans: DataFrame, keys: list[str], gap_us: int = 0, bucket_us: int = BUCKET_US) -> DataFrame:
    """Join spans that overlap or lie at most `gap_us` apart: ``keys, s_us, e_us, n``.

    A span inside an earlier one is absorbed: what counts is the greatest end so far.
    A scan in two levels: spans are joined within the time bucket they start in; the
    furthest end and the last start are carried over a key's buckets; what reaches
    into a bucket takes in the islands at its beginning.  So a busy key is spread over
    its buckets.
    """
    within = Window.partitionBy(*keys, "bucket").orderBy("s_us", "e_us")
    reach = F.max("e_us").over(within.rowsBetween(Window.unboundedPreceding, -1))
    dealt = positive(spans).select(*keys, "s_us", "e_us", _bucket(F.col("s_us"), bucket_us).alias("bucket"))
    opened = dealt.withColumn("opens", F.when(F.col("s_us") <= reach + gap_us, 0).otherwise(1))
    island = opened.withColumn("island", F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # read twice: for what is carried, and for the islands
    local = materialised(island.groupBy(*keys, "bucket", "island").agg(F.min("s_us").alias("s_us"), F.max("e_us").alias("e_us"), F.count("*").alias("n")))
    summary = local.groupBy(*keys, "bucket").agg(F.max("e_us").alias("reach"), F.max("s_us").alias("last"))

    def carry(line: Column) -> dict[str, Column]:
        before = running(F.transform(line, lambda x: x["reach"]), lambda a, b: F.greatest(a, b))
        reached = F.concat(F.array(F.lit(None).cast("long")), before)
        # a bucket opens an island of its own unless its last one is still reached
        opens = F.zip_with(line, F.slice(reached, 1, F.size(line)), lambda x, r: F.when(r.isNull() | (x["last"] > r + gap_us), x["last"]))
        return {"reach": reached, "opener": F.concat(F.array(F.lit(None).cast("long")), running(opens, lambda a, b: F.greatest(a, b)))}

    seamed = _with_carry(local, keys, _carried(summary, keys, ["reach", "last"], carry))
    owner = F.when(F.col("s_us") <= F.col("reach") + gap_us, F.col("opener")).otherwise(F.col("s_us"))
    return seamed.groupBy(*keys, owner.alias("owner")).agg(F.min("s_us").alias("s_us"), F.max("e_us").alias("e_us"), F.sum("n").alias("n")).drop("owner")


def session_union(spans: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """The same as `union`, as session windows whose gap is the span's length plus `gap_us`.

    Works on streams too.  A session takes a span that begins before its end, so one
    microsecond is added for the inclusive gap.
    """
    timed = positive(spans).withColumn("at", F.timestamp_micros("s_us"))
    gap = F.concat((F.col("e_us") - F.col("s_us") + gap_us + 1).cast("string"), F.lit(" microseconds"))
    return timed.groupBy(*keys, F.session_window("at", gap)).agg(F.min("s_us").alias("s_us"), F.max("e_us").alias("e_us"), F.count("*").alias("n")).drop("session_window")


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def sweep(edges: DataFrame, keys: list[str], counts: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """Elementary pieces between edges, with how many spans of each kind are open.

    ``edges`` has ``keys, t_us`` and a change for each of `counts`.  A scan in two
    levels: changes add up within time buckets, and what is open at the end of a
    bucket, and where the next one begins, is carried over a key's buckets.
    """
    # read twice: for what is carried, and for the pieces
    instants = materialised(edges.groupBy(*keys, _bucket(F.col("t_us"), bucket_us).alias("bucket"), "t_us").agg(*[F.sum(c).alias(c) for c in counts]))
    within = Window.partitionBy(*keys, "bucket").orderBy("t_us")
    summary = instants.groupBy(*keys, "bucket").agg(F.min("t_us").alias("first"), *[F.sum(c).alias(c) for c in counts])

    def carry(line: Column) -> dict[str, Column]:
        before = {f"{c}_before": F.concat(F.array(F.lit(0).cast("long")), running(F.transform(line, _field(c)), lambda a, b: a + b)) for c in counts}
        return before | {"next_us": F.transform(F.slice(line, 2, F.size(line)), lambda x: x["first"])}

    along = instants.withColumns({**{c: F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)) for c in counts}, "e_us": F.lead("t_us").over(within)})
    seamed = _with_carry(along, keys, _carried(summary, keys, ["first", *counts], carry))
    open_ = [(F.col(c) + F.col(f"{c}_before")).alias(c) for c in counts]
    return seamed.select(*keys, F.col("t_us").alias("s_us"), *open_, F.coalesce("e_us", "next_us").alias("e_us")).filter("e_us is not null")


def edges(spans: DataFrame, keys: list[str], weights: dict[str, int]) -> DataFrame:
    """Each span's two edges, with `weights` at its start and their negatives at its end."""
    both = F.array(
        F.struct(F.col("s_us").alias("t_us"), *[F.lit(w).alias(c) for c, w in weights.items()]),
        F.struct(F.col("e_us").alias("t_us"), *[F.lit(-w).alias(c) for c, w in weights.items()]),
    )
    return spans.select(*keys, F.explode(both).alias("edge")).select(*keys, "edge.*")


def overlap(turns: DataFrame, rec: str = "rec", spk: str = "spk") -> DataFrame:
    """Where two or more speakers are active at once: ``rec, s_us, e_us``, touching pieces joined."""
    own = union(turns, [rec, spk])
    pieces = sweep(edges(own, [rec], {"depth": 1}), [rec], ["depth"]).filter("depth >= 2")
    return union(pieces, [rec]).select(rec, "s_us", "e_us")


def subtract(spans: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """What the spans cover and the holes do not: ``keys, s_us, e_us``."""
    marks = edges(positive(spans), keys, {"on": 1, "off": 0}).unionByName(edges(positive(holes), keys, {"on": 0, "off": 1}))
    pieces = sweep(marks, keys, ["on", "off"]).filter("on > 0 and off = 0")
    return union(pieces, keys).select(*keys, "s_us", "e_us")


def solo(turns: DataFrame, target: str, gap_us: int = GAP_US, rec: str = "rec", spk: str = "spk") -> DataFrame:
    """Where only the target speaks: its turns, joined over small gaps, without any overlap."""
    own = union(turns.filter(F.col(spk) == target), [rec], gap_us).select(rec, "s_us", "e_us")
    return subtract(own, overlap(turns, rec, spk), [rec])


def clamp(spans: DataFrame, end_us: Column | int) -> DataFrame:
    """Spans cut to [0, end); an open end (null) runs to the end of the recording."""
    end = end_us if isinstance(end_us, Column) else F.lit(end_us)
    cut = spans.withColumns({"s_us": F.greatest("s_us", F.lit(0).cast("long")), "e_us": F.least(F.coalesce("e_us", end), end)})
    return positive(cut)


def padded(spans: DataFrame, pad_us: int, end_us: int) -> DataFrame:
    """Spans grown on both sides, cut to the recording."""
    return clamp(spans.withColumns({"s_us": F.col("s_us") - pad_us, "e_us": F.col("e_us") + pad_us}), end_us)


def complement(spans: DataFrame, keys: list[str], end_us: int, recordings: DataFrame | None = None) -> DataFrame:
    """What no span covers in [0, end): ``keys, s_us, e_us``.

    Keys are those of `recordings`, so that one without any span is free from end to
    end; without it, those of the spans.
    """
    held = clamp(spans, end_us)
    every = (held if recordings is None else held.select(*keys).unionByName(recordings.select(*keys))).select(*keys).distinct()
    return subtract(every.withColumns({"s_us": F.lit(0).cast("long"), "e_us": F.lit(end_us).cast("long")}), held, keys)


def _dealt(spans: DataFrame, side: str, bucket_us: int, grown_us: int = 0) -> DataFrame:
    """Spans with their columns named by side, once for each time bucket they touch when grown on both sides."""
    named = spans.select(*[F.col(c).alias(f"{side}_{c}") for c in spans.columns])
    first, last = _bucket(F.col(f"{side}_s_us") - grown_us, bucket_us), _bucket(F.col(f"{side}_e_us") + grown_us - 1, bucket_us)
    return named.withColumn(f"{side}_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def _same(keys: list[str]) -> list[Column]:
    """Equal keys and time bucket: a busy recording is spread over its buckets."""
    return [*[F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys], F.col("l_bucket") == F.col("r_bucket")]


def _once(bucket_us: int) -> Column:
    """A pair that meets in several buckets counts where the later one starts."""
    return _bucket(F.greatest("l_s_us", "r_s_us"), bucket_us) == F.col("l_bucket")


def range_join(left: DataFrame, right: DataFrame, key: str | list[str], bucket_us: int = BUCKET_US, how: str = "inner") -> DataFrame:
    """Pairs of spans (columns ``l_*`` and ``r_*``) with equal keys that overlap.

    Both sides are dealt into time buckets, so the join is an equi join on keys and
    bucket.  With ``how="left"`` a left span has a row with nulls in each of its
    buckets where no pair counts.
    """
    keys = [key] if isinstance(key, str) else key
    overlapping = [F.col("l_s_us") < F.col("r_e_us"), F.col("r_s_us") < F.col("l_e_us"), _once(bucket_us)]
    return _dealt(left, "l", bucket_us).join(_dealt(right, "r", bucket_us), [*_same(keys), *overlapping], how).drop("l_bucket", "r_bucket")


def clip_to_regions(spans: DataFrame, regions: DataFrame, keys: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """Spans cut to each region they touch and counted from its start: ``keys, region_id, s_us, e_us``."""
    met = range_join(spans.select(*keys, "s_us", "e_us"), regions.select(*keys, "region_id", "s_us", "e_us"), keys, bucket_us)
    return met.select(*[F.col(f"l_{k}").alias(k) for k in keys], F.col("r_region_id").alias("region_id"), (F.greatest("l_s_us", "r_s_us") - F.col("r_s_us")).alias("s_us"), (F.least("l_e_us", "r_e_us") - F.col("r_s_us")).alias("e_us"))


def snap_outward(regions: DataFrame, spans: DataFrame, keys: list[str], end_us: int, eps_us: int = 1000, bucket_us: int = BUCKET_US) -> DataFrame:
    """Move region edges that fall into a span out to the span's edge: ``keys, region_id, s_us, e_us``.

    Each edge looks up the spans of its own time bucket.
    """
    edge = F.explode(F.array(F.struct(F.col("s_us").alias("t_us"), F.lit(True).alias("is_start")), F.struct(F.col("e_us").alias("t_us"), F.lit(False).alias("is_start"))))
    points = regions.select(*keys, "region_id", "s_us", "e_us", edge.alias("edge")).select(*keys, "region_id", "s_us", "e_us", "edge.*")
    left = points.select(*[F.col(c).alias(f"l_{c}") for c in points.columns], _bucket(F.col("t_us"), bucket_us).alias("l_bucket"))
    inside = [F.col("r_s_us") - eps_us < F.col("l_t_us"), F.col("l_t_us") < F.col("r_e_us") + eps_us]
    met = left.join(_dealt(spans.select(*keys, "s_us", "e_us"), "r", bucket_us, eps_us), [*_same(keys), *inside], "left")
    low, high = F.min(F.when(F.col("l_is_start"), F.col("r_s_us"))), F.max(F.when(~F.col("l_is_start"), F.col("r_e_us")))
    snapped = met.groupBy(*[F.col(f"l_{k}").alias(k) for k in keys], F.col("l_region_id").alias("region_id"), F.col("l_s_us").alias("s0"), F.col("l_e_us").alias("e0")).agg(low.alias("low"), high.alias("high"))
    return clamp(snapped.select(*keys, "region_id", F.least("s0", "low").alias("s_us"), F.greatest("e0", "high").alias("e_us")), end_us)


def points_inside(points: DataFrame, spans: DataFrame, keys: list[str], eps_us: int = 10_000, bucket_us: int = BUCKET_US) -> DataFrame:
    """Points (``keys, t_us``) strictly inside some span, `eps_us` away from its edges; other columns stay."""
    named = {c: f"l_{c}" for c in points.columns}
    left = points.withColumnsRenamed(named).withColumn("l_bucket", _bucket(F.col("l_t_us"), bucket_us))
    inside = [F.col("r_s_us") + eps_us < F.col("l_t_us"), F.col("l_t_us") < F.col("r_e_us") - eps_us]
    met = left.join(_dealt(spans.select(*keys, "s_us", "e_us"), "r", bucket_us), [*_same(keys), *inside], "left_semi")
    return met.select(*[F.col(n).alias(c) for c, n in named.items()])


def frame_ranges(spans: DataFrame, n: Column | str, rate: int = 100) -> DataFrame:
    """Spans as frame ranges ``first, past`` (past at most `n`): halves of a frame round to even, the last frame is taken in."""
    n = F.col(n) if isinstance(n, str) else n
    at = lambda c: F.bround(F.col(c) * rate / 1_000_000, 0).cast("long")
    return spans.withColumns({"first": at("s_us"), "past": F.least(n.cast("long"), at("e_us") + 1)})


def speech_ratio(spans: DataFrame, keys: list[str], total_us: int) -> DataFrame:
    """Summed span lengths over the total, within [0, 1]; overlaps count twice."""
    summed = spans.groupBy(*keys).agg(F.sum(F.greatest(F.col("e_us") - F.col("s_us"), F.lit(0).cast("long"))).alias("speech_us"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("speech_us") / total_us)) if total_us > 0 else F.lit(0.0)
    return summed.withColumn("ratio", ratio)


def duration(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the union of the spans."""
    return union(spans, keys).groupBy(*keys).agg(F.sum(F.col("e_us") - F.col("s_us")).alias("covered_us"), F.count("*").alias("islands"))


def chunk_cover(totals: DataFrame, keys: list[str], total: str, chunk_us: int) -> DataFrame:
    """Chunks of `chunk_us` that cover [0, total): none for an empty total, one if the chunk is not positive."""
    live = totals.filter(F.col(total) > 0)
    if chunk_us <= 0:
        return live.select(*keys, F.lit(0).alias("chunk_no"), F.lit(0).cast("long").alias("s_us"), F.col(total).cast("long").alias("e_us"))
    starts = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col(total).cast("long") - 1, F.lit(chunk_us).cast("long")))
    return live.select(*keys, total, starts.alias("chunk_no", "s_us")).select(*keys, "chunk_no", "s_us", F.least(F.col("s_us") + chunk_us, F.col(total).cast("long")).alias("e_us"))


def equal_split(spans: DataFrame, keys: list[str], most_us: int, least_us: int) -> DataFrame:
    """Cut spans longer than `most_us` into equal parts; parts under `least_us` are dropped. Edges in whole milliseconds."""
    length = F.col("e_us") - F.col("s_us")
    parts = spans.withColumn("parts", F.greatest(F.lit(1), F.ceil(length / most_us)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    edge = lambda i: F.col("s_us") + F.round(length * i / F.col("parts") / 1000).cast("long") * 1000
    cut = parts.select(*keys, "part", edge(F.col("part")).alias("a"), edge(F.col("part") + 1).alias("b"))
    return cut.filter(F.col("b") - F.col("a") >= least_us).select(*keys, "part", F.col("a").alias("s_us"), F.col("b").alias("e_us"))


def tiles(spans: DataFrame, keys: list[str], most_us: int, least_us: int) -> DataFrame:
    """Windows of `most_us` one after another while at least `least_us` is left; the last is cut."""
    room = spans.filter(F.col("e_us") - F.col("s_us") >= least_us)
    starts = F.posexplode(F.sequence("s_us", F.col("e_us") - least_us, F.lit(most_us).cast("long"))).alias("tile", "t_us")
    return room.select(*keys, "e_us", starts).select(*keys, "tile", F.col("t_us").alias("s_us"), F.least(F.col("t_us") + most_us, F.col("e_us")).alias("e_us"))


def offset_merge(parts: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Turns found in chunks, moved to the time of the recording: joins on keys and ``chunk_no``."""
    begins = chunks.select(*keys, "chunk_no", F.col("s_us").alias("chunk_us"))
    return parts.join(begins, [*keys, "chunk_no"]).withColumns({"s_us": F.col("s_us") + F.col("chunk_us"), "e_us": F.col("e_us") + F.col("chunk_us")}).drop("chunk_us")


def overlap_of_windows(windows: DataFrame, spans: DataFrame, keys: list[str], name: str = "voiced_us", bucket_us: int = BUCKET_US) -> DataFrame:
    """Each window with the summed overlap of the spans (overlapping spans count twice)."""
    met = range_join(windows, spans.select(*keys, "s_us", "e_us"), keys, bucket_us, "left")
    both = F.least("r_e_us", "l_e_us") - F.greatest("r_s_us", "l_s_us")
    covered = F.sum(F.when(F.col("r_s_us").isNotNull(), both))
    return met.groupBy(*[F.col(f"l_{c}").alias(c) for c in windows.columns]).agg(F.coalesce(covered, F.lit(0).cast("long")).alias(name))


def halved(chunks: DataFrame, keys: list[str], fits: Column, floor_us: int = 15_000_000, most_rounds: int = 40) -> DataFrame:
    """Chunks that fit, after halving those that do not, again and again: ``keys, s_us, e_us, skipped``.

    `fits` is a predicate on ``s_us`` and ``e_us``.  A chunk that does not fit and is
    no longer than two floors is skipped (its text is empty).  The first half is a
    millisecond longer.
    """
    length = F.col("e_us") - F.col("s_us")
    rows = chunks.select(*keys, "s_us", "e_us")
    longest = rows.agg(F.max(length)).first()[0] or 0
    rounds = 0
    while longest > 2 * floor_us:
        if rounds == most_rounds:
            raise RuntimeError(f"chunks are still longer than two floors after {most_rounds} halvings")
        middle = F.col("s_us") + F.floor(length / 2).cast("long") + 1000
        pieces = F.when(fits | (length <= 2 * floor_us), F.array(F.struct("s_us", "e_us"))).otherwise(F.array(F.struct("s_us", middle.alias("e_us")), F.struct(middle.alias("s_us"), "e_us")))
        rows = rows.select(*keys, F.explode(pieces).alias("piece")).select(*keys, "piece.*")
        longest, rounds = longest / 2 + 1000, rounds + 1
    return rows.withColumn("skipped", ~fits)
