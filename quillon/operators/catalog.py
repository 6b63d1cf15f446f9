"""Browsing results: runs, newest files, search, pages, stage times, rates, prerequisites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], value: str, when: str) -> DataFrame:
    """The newest value of each key; the greatest on ties."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(when, value)).alias(value), F.max(when).alias(when))


def matches(query: str, *columns: str) -> Column:
    """Whether some column holds the query, case ignored; a blank query matches all."""
    asked = query.strip().lower()
    if not asked:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(c), F.lit(asked))
    return F.coalesce(found, F.lit(False))


def page(rows: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """One page (numbered from 0) of the ordered rows."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def speaker_of(path: Column) -> Column:
    """Speaker from a run's folder: what stands before the first underscore of its name."""
    return F.substring_index(F.element_at(F.split(path, "[/\\\\]"), -1), "_", 1)


def stage_times(rows: DataFrame, run: str, when: str) -> DataFrame:
    """Each stage with its end, which is the start of the next (null for the last)."""
    along = Window.partitionBy(run).orderBy(when, "event_id")
    return rows.withColumn("ends", F.lead(when).over(along))


def trailing_rate(rows: DataFrame, key: str, at_us: str, span_us: int) -> DataFrame:
    """Adds ``rate``: events of the key in the last `span_us`, this one included."""
    return rows.withColumn("rate", F.count("*").over(Window.partitionBy(key).orderBy(at_us).rangeBetween(-span_us, 0)))


def last_lines(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The last `most` rows of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_nth") <= most).drop("_nth")


def closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """All (node, needs) pairs reachable over ``edges``, by doubling: rounds grow as the logarithm of the depth.

    Pairs are known with their distance.  A round joins those that are exactly as far
    apart as the last round reached with all that are known, so a pair is found once for
    each place in the middle of its shortest ways, and not once for each way to cut
    them.  A node that very many others need is split (`shared.split_join`).  Edges
    with a null end lead nowhere and go.  After `most_rounds` it raises.
    """
    from quillon.plans.shared import materialised, split_join

    known = materialised(edges.select("node", "needs").dropna().distinct().withColumn("far", F.lit(1).cast("long")))
    reach = 1
    for _ in range(most_rounds):
        farthest = known.filter(F.col("far") == reach).select("node", F.col("needs").alias("via"))
        if farthest.isEmpty():
            return known.select("node", "needs")
        step = split_join(farthest, known.select(F.col("node").alias("via"), "needs", "far"), "via", "node")
        found = step.groupBy("node", "needs").agg((F.min("far") + reach).alias("far"))
        known = materialised(known.union(found.join(known, ["node", "needs"], "left_anti").select("node", "needs", "far")))
        reach *= 2
    raise RuntimeError("closure did not settle")


def capped(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first `most` of the ordered rows, with the true number of all as ``total``."""
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def first_seen(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each value of each key once, in the order in which it is first seen: ``keys, value, nth``."""
    firsts = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("at"))
    return firsts.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("at", value)) - 1).drop("at")


def bars(rows: DataFrame, keys: list[str], name: str, target: str) -> DataFrame:
    """Adds ``bar``, the place of a row of a chart: the target first, then by name."""
    order = Window.partitionBy(*keys).orderBy((F.col(name) != target), name)
    return rows.withColumn("bar", F.row_number().over(order) - 1)


# The files and folders of a run.
METADATA = "dataset/metadata.csv"
VISUALS = "visualizations/"
SOLO = "(?i)^concatenated_audio_solo_verified/[^/]+[.]wav$"
CLIPS = "^dataset/wavs/([^/]+)/"


def reviewable(has_dataset: Column, has_visuals: Column, has_solo: Column) -> Column:
    """Whether a folder is a run that can be reviewed."""
    return has_dataset | has_visuals | has_solo


def runs(files: DataFrame, root: str) -> DataFrame:
    """Runs of a listing (``path, modified_us``): the root and its direct children that can be reviewed.

    One row a run: ``run, speaker, has_dataset, has_visuals, has_solo, modified_us``
    (of its newest file).  The speaker is the clips' folder, else what stands before
    the first underscore of the run's name.  Files elsewhere belong to no run.
    """
    base = root.rstrip("/")
    inside = files.filter(F.startswith("path", F.lit(f"{base}/"))).withColumn("rest", F.expr(f"substring(path, {len(base) + 2})"))
    child = F.substring_index("rest", "/", 1)
    below = F.when(F.contains("rest", F.lit("/")), F.struct(F.concat(F.lit(f"{base}/"), child).alias("run"), F.expr("substring(rest, locate('/', rest) + 1)").alias("rest")))
    both = F.array_compact(F.array(F.struct(F.lit(base).alias("run"), F.col("rest")), below))
    placed = inside.select("modified_us", F.explode(both).alias("x")).select("modified_us", "x.*")
    speaker = F.regexp_extract("rest", CLIPS, 1)
    found = placed.groupBy("run").agg(
        F.min(F.when(speaker != "", speaker)).alias("speaker"),
        F.bool_or(F.col("rest") == METADATA).alias("has_dataset"),
        F.bool_or(F.startswith("rest", F.lit(VISUALS))).alias("has_visuals"),
        F.bool_or(F.col("rest").rlike(SOLO)).alias("has_solo"),
        F.max("modified_us").alias("modified_us"),
    )
    named = found.withColumn("speaker", F.coalesce("speaker", speaker_of(F.col("run"))))
    return named.filter(reviewable(F.col("has_dataset"), F.col("has_visuals"), F.col("has_solo")))


def newest_below(files: DataFrame, root: str, name: str, depth: int = 4) -> DataFrame:
    """``path, modified_us`` of the newest file of a name at most `depth` folders below the root; the greatest path on ties."""
    base = root.rstrip("/")
    steps = F.size(F.split(F.expr(f"substring(path, {len(base) + 2})"), "/")) - 1
    named = files.filter(F.startswith("path", F.lit(f"{base}/")) & (F.substring_index("path", "/", -1) == name) & (steps <= depth))
    return named.agg(F.max(F.struct("modified_us", "path")).alias("m")).filter("m is not null").select("m.path", "m.modified_us")


def clip_paths(clips: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``wav``: ``folder/id.wav`` where the listing (``path``) has it, else ``folder/id``, as an id may carry its ending."""
    full = F.concat("folder", F.lit("/"), "id", F.lit(".wav"))
    there = files.select(F.col("path").alias("full")).distinct().withColumn("there", F.lit(True))
    return clips.withColumn("full", full).join(there, "full", "left").withColumn("wav", F.when(F.col("there"), F.col("full")).otherwise(F.concat("folder", F.lit("/"), "id"))).drop("full", "there")


def paired(checked: DataFrame, fine: DataFrame, key: str) -> DataFrame:
    """Checked slices with their high-quality version; slices without one are dropped."""
    return checked.join(fine, key)
