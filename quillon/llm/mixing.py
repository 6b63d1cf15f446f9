"""Operator 8: mixing sources to target weights, as a time-varying curriculum.

Targets: every source gets a share of the total by its weight, up to a bound of
repeats; what is cut off is shared again.  Schedule: a source's weight over
training time t in [0, 1] is a line of mean 1, so its integral is a quadratic
that is inverted in closed form.  A document that begins x of the way into its
source's token demand is trained on where the integral reaches x.

Running token counts come in two levels: documents are dealt by a hash into
slots of their source, slots are summed, and only within a slot are documents
counted one after another.  A source with a third of all rows is thus spread
over `SLOTS` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.frames import cut, hidden, table, word_count

MOST_REPEATS = 3
SLOTS = 4096
#: Slope of the schedule of the sources, repeating in code-point order: falling, level, rising.
SLOPES = (-0.8, 0.0, 0.8)
WEIGHTS = (1.0, 2.0, 3.0)


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of ``source`` by code point (null last), from 0 on.

    Sources are dealt into ranges, ranked inside each, and moved by the counts of
    the ranges before, so that no task sees all of them.
    """
    # ranges are drawn from a sample, so they are written once and read by both uses
    parts = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    # one row a range
    return parts.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("inside")).select(*sizes.columns, "rank")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources: ``sizes`` has ``source, source_size``; adds ``target`` and ``slope``.

    Sources count by code point, null last.  All get the same level times their
    weight, but no more than their bound.  Each round shares what the bounded
    sources leave among the others, until no other is above its bound; it is one
    aggregate over the sources, and two numbers come back.
    """
    ranked = _ranked(sizes)
    ranked = ranked.withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("slope", _cycle(slopes, F.col("rank")))
    ranked = cut(ranked.withColumn("bound", F.col("source_size") * most).withColumn("per_weight", F.col("bound") / F.col("weight")).drop("rank"))
    level, bounded = 0.0, -1
    while True:
        full = F.col("per_weight") < level
        row = ranked.agg(F.count_if(full).alias("n"), F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("bound"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if row.n == bounded or not row.weight:
            break
        level, bounded = (row.total - (row.held or 0)) / row.weight, row.n
    return ranked.select("source", "source_size", "slope", F.least(F.col("bound").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def position(x: Column, slope: Column) -> Column:
    """Where the integral of 1 + slope * (2t - 1) reaches x."""
    rise = 1 - slope
    return F.when(slope == 0, x).otherwise((F.sqrt(rise * rise + 4 * slope * x) - rise) / (2 * slope))


MIXED = ["size", "source_size", "target", "taken", "first_word", "slope", "position"]


def sized(docs: DataFrame) -> DataFrame:
    """Adds ``size`` (words) and ``slot_hash`` (the order of a source's documents, from id and text)."""
    said = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.withColumns({"size": word_count(), "slot_hash": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), said).cast("binary"))})


def _placed(docs: DataFrame, weights: tuple[float, ...], slopes: tuple[float, ...], most: int) -> DataFrame:
    """Adds `MIXED` to documents with ``doc_id, source, size, slot_hash``."""
    dealt = docs.withColumn("slot_no", F.conv(F.substring("slot_hash", 1, 3), 16, 10).cast("int"))
    slots = cut(dealt.groupBy("source", "slot_no").agg(F.sum("size").alias("slot_size")))
    wanted = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, slopes, most)
    along = Window.partitionBy("source").orderBy("slot_no").rowsBetween(Window.unboundedPreceding, -1)
    begins = slots.withColumn("slot_begin", F.coalesce(F.sum("slot_size").over(along), F.lit(0))).select(F.col("source").alias("of_source"), F.col("slot_no").alias("of_slot"), "slot_begin")
    plan = begins.join(wanted, F.col("of_source").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "slot_no").orderBy("slot_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("in_slot", F.coalesce(F.sum("size").over(within), F.lit(0)))
    run = run.join(plan, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slot_no") == F.col("of_slot")))
    run = run.withColumn("first_word", F.col("slot_begin") + F.col("in_slot"))
    taken = sum(pass_taken(p) for p in range(most))
    x = (F.col("first_word") + F.col("size") / 2) / F.col("target")
    run = run.withColumn("taken", taken.cast("long"))
    return run.withColumn("position", F.when(F.col("taken") > 0, position(F.least(x, F.lit(1.0)), F.col("slope"))))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST_REPEATS) -> DataFrame:
    """How many words of each document the mix takes, and when.

    ``docs`` needs ``doc_id``, ``source`` and ``text``; all its columns stay,
    whatever their names, but for those named like the new ones, which are
    replaced: ``size`` (words), ``source_size``, ``target`` (words of the source),
    ``taken`` (words, repeats counted), ``first_word`` (where the document begins
    in its source), ``slope`` and ``position`` (0 to 1, of the first take; null if none).

    A source is read round and round in the order of a hash of id and text until
    its target is reached, so the last document may be taken in part.  Null texts
    and texts without words have size 0 and are never taken; a null source is a
    source.  Rows without an id, or with one id, are ordered by their texts' hash;
    rows that agree in both tie and are interchangeable.  An empty table gives an
    empty result.
    """
    plain, back = hidden(docs.drop(*MIXED), ["doc_id", "source", "text"])
    return _placed(sized(plain), weights, slopes, most).select(*back, *MIXED)


def pass_taken(number: int) -> Column:
    """Words taken of a document in one reading of its source (numbered from 0)."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("source_size") * number - F.col("first_word")))


TAKES = ["take", "take_words", "take_position"]


def training_rows(mixed: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """One row for each take of a document (what `mix` gives), range-sorted by training position.

    Adds ``take`` (from 0), ``take_words`` and ``take_position``; other columns of
    these names are replaced.  Documents that are not taken have no row.
    """
    plain, back = hidden(mixed.drop(*TAKES), ["doc_id", *MIXED])
    takes = F.array(*[F.struct(F.lit(p).alias("take"), pass_taken(p).alias("take_words")) for p in range(most)])
    rows = plain.withColumn("one", F.explode(F.filter(takes, lambda x: x["take_words"] > 0))).select(*plain.columns, "one.take", "one.take_words")
    x = F.least(F.lit(1.0), (F.col("first_word") + F.col("source_size") * F.col("take") + F.col("take_words") / 2) / F.col("target"))
    return rows.withColumn("take_position", position(x, F.col("slope"))).orderBy("take_position", "doc_id", "take").select(*back, *TAKES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, weights 1, 2, 3, at most three takes; in training order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # words are counted once; texts are not needed any more
    slim = cut(sized(docs).drop("text"))
    mixed = _placed(slim, WEIGHTS, SLOPES, MOST_REPEATS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM src),
weighed AS (
  SELECT source, source_size, CAST(r % 3 + 1 AS DOUBLE) AS weight,
         CASE r % 3 WHEN 0 THEN CAST(-0.8 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS slope,
         CAST(source_size * 3 AS DOUBLE) AS bound, CAST(source_size * 3 AS DOUBLE) / CAST(r % 3 + 1 AS DOUBLE) AS per_weight
  FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY per_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY per_weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
common AS (SELECT arg_min(level, per_weight) AS common FROM levels WHERE per_weight >= level),
targets AS (SELECT source, source_size, slope, least(bound, common * weight) AS target FROM levels, common),
placed AS (
  SELECT doc_id, size, source_size, target, slope,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, greatest(0, least(size, floor(target) - first_word)) + greatest(0, least(size, floor(target) - source_size - first_word))
          + greatest(0, least(size, floor(target) - source_size * 2 - first_word)) AS taken,
         least((first_word + size / 2) / target, 1.0) AS x
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN x ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope) END END AS position
FROM counted
"""
