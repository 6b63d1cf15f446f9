"""Operator 4: chat formatting after collapsing cumulative snapshots.

Chat logs often hold the same conversation several times, each longer by a few
turns.  Every turn has hashes salted with its place; their running sums are
rolling hashes of the turn prefixes.  A conversation whose whole hash is a prefix
hash of a longer one (or of an equal one with a smaller id) is a snapshot.
Anti-joins keep the maximal conversations, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.frames import table

_PREFIX = ["n", "hash_a", "hash_b", "hash_c"]


def _salted(seed: int) -> Column:
    """40 bits of a turn's hash at its place; sums of them stay exact in a long."""
    return F.xxhash64(F.lit(seed), "place", "role", "text").bitwiseAND(F.lit((1 << 40) - 1))


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn of the template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """Turns of the maximal conversations: ``conv_id, place`` (from 1), ``role, text``.

    ``conversations`` needs ``conv_id, turn, role, text``; other columns are
    ignored.  Turns are ordered by ``turn`` (nulls first), then role and text.  A
    null role or text counts as empty.  Turns without ``conv_id`` belong to no
    conversation and are left out.  Of equal conversations the one with the least
    id stays.  An empty table gives an empty result.
    """
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("place", F.row_number().over(in_order))
    running = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    conversation = Window.partitionBy("conv_id")
    sums = {name: F.sum(_salted(i)).over(running) for i, name in enumerate(_PREFIX[1:])}
    hashed = placed.withColumns(sums).withColumn("turns", F.count("*").over(conversation)).select("conv_id", F.col("place").alias("n"), *_PREFIX[1:], "turns")
    # one row a prefix, whoever has it: a first turn that all conversations share is combined before the shuffle
    longest = hashed.groupBy(*_PREFIX).agg(F.max("turns").alias("longest"), F.min(F.when(F.col("n") == F.col("turns"), F.col("conv_id"))).alias("conv_id"))
    whole = longest.filter("conv_id is not null").select(*_PREFIX, "conv_id")
    maximal = whole.join(longest.filter("longest > n").select(*_PREFIX), _PREFIX, "left_anti").select("conv_id")
    return placed.join(maximal, "conv_id", "left_semi").select("conv_id", "place", "role", "text")


def render(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, rendered``.

    ``turns`` is what `collapse` gives; other columns are ignored.  A null role or
    text makes its turn vanish from the text (`collapse` leaves none), an empty
    one is shown empty.  Turns that tie in ``place`` follow by their text.  An
    empty table gives an empty result.
    """
    ordered = F.array_sort(F.collect_list(F.struct("place", rendered_turn(F.col("role"), F.col("text")).alias("shown"))))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(ordered, lambda x: x["shown"]), "").alias("rendered"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, snapshots collapsed, rendered."""
    return render(collapse(table(spark, sf_dir, "conversations")))


OP4_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown
  FROM conversations WHERE conv_id IS NOT NULL),
prefixes AS (
  SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS turns,
         string_agg(shown, '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM turns),
longest AS (
  SELECT place, prefix, max(turns) AS longest, min(CASE WHEN place = turns THEN conv_id END) AS least FROM prefixes GROUP BY place, prefix)
SELECT p.conv_id, p.turns AS n_turns, p.prefix AS rendered
FROM prefixes p JOIN longest l ON p.place = l.place AND p.prefix = l.prefix
WHERE p.place = p.turns AND l.longest = p.turns AND l.least = p.conv_id
"""
