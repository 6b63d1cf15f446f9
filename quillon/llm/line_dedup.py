"""Operator 2: line dedup by prefix doubling over line sequences.

A suffix of a document's lines is named by the earliest place where its first h
lines stand, so suffixes with one name form an interval of common prefix h.
Names for 2h come from the pairs (name at i, name at i + h).  Suffixes whose name
is theirs alone are dropped at once: no longer prefix of theirs repeats.  At the
run length every suffix that does not hold its own name starts a run that stands
earlier too; the lines of such runs, joined where they overlap into maximal
repeated runs, are the later copies that are deleted.

Runs can be measured in words instead, so that one long line counts.  A repeated
run of enough words is the union of its least windows: from each line on, and back
from each line, as few lines as have the words.  Equal windows have equal lengths,
and a window of h lines is named by the names of the powers of two that cover it
from both ends, so doubling goes on while names repeat and windows are longer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.frames import cut, discard, table, with_totals, word_count

#: Fewest lines of a repeated run.
RUN = 3
#: Fewest words of a repeated run where runs are measured in words.
WORDS = 20
_PLACE = ["doc", "row", "line"]


def _named(keyed: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Name rows by the earliest place of their keys; rows with keys of their own are dropped.

    A key that very many places have (a blank line) is split over several tasks.
    """
    named = with_totals(keyed, keys, _PLACE, F.min(F.struct(*_PLACE)).alias("name"), F.count("*").alias("times"), having="times > 1")
    return named.select(*_PLACE, *more, "name")


def _doubled(names: DataFrame, shift: int) -> DataFrame:
    """Names of `shift` lines more: of the pair at a place and `shift` lines on."""
    here = names.withColumnRenamed("name", "first")
    later = names.select("doc", "row", (F.col("line") - shift).alias("line"), F.col("name").alias("then"))
    return _named(here.join(later, _PLACE), ["first", "then"])


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Starts (``doc, row, line``) of runs of `run` lines that also start earlier."""
    lines = docs.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    # a place is one row, however often its document was given
    places = lines.select(*_PLACE, F.xxhash64("content").alias("a"), F.hash("content").alias("b"), F.length("content").alias("c")).dropDuplicates(_PLACE)
    names = cut(_named(places, ["a", "b", "c"]))
    h = 1
    while h < run:
        step = min(h, run - h)
        former, names = names, cut(_doubled(names, step))
        discard(former)
        h += step
    return names.filter(F.struct(*_PLACE) != F.col("name")).select(*_PLACE)


def _windows(docs: DataFrame, words: int) -> DataFrame:
    """Lines with their hashes ``a, b, c``, and how many lines have `words` words from it on (``ahead``) and back from it (``back``; ends before it).

    Each document has one more line, without hashes, after its last.
    """
    parts = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), F.length(x).alias("c"), word_count(x).alias("n")))
    end = F.array(F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("int").alias("c"), F.lit(0).cast("long").alias("n")))
    # rows that agree in id and text are one document
    one = docs.select("doc", "row", F.concat(parts, end).alias("parts")).groupBy("doc", "row").agg(F.first("parts").alias("parts"))
    lines = one.select("doc", "row", F.posexplode("parts").alias("line", "x")).select(*_PLACE, "x.*")
    document = Window.partitionBy("doc", "row")
    summed = lines.withColumn("before", F.sum("n").over(document.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    past = F.min("line").over(document.orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -words))
    first = F.max("line").over(document.orderBy("before").rangeBetween(Window.unboundedPreceding, -words))
    return summed.select(*_PLACE, "a", "b", "c", (past - F.col("line")).alias("ahead"), (F.col("line") - first).alias("back"))


def repeated_spans(docs: DataFrame, words: int) -> DataFrame:
    """Least windows (``doc, row, line, h``: h lines from line on) of `words` words that also start earlier."""
    lines = cut(_windows(docs, words))
    ahead = lines.filter("ahead is not null").select(*_PLACE, F.col("ahead").alias("h"))
    back = lines.filter("back is not null").select("doc", "row", (F.col("line") - F.col("back")).alias("line"), F.col("back").alias("h"))
    windows = ahead.union(back).distinct()
    names = cut(_named(lines.filter("a is not null").select(*_PLACE, "a", "b", "c"), ["a", "b", "c"]))
    most = lines.agg(F.max(F.greatest("ahead", "back")).alias("h")).first().h or 0
    h, found = 1, []
    while h <= most:
        here = names.withColumnRenamed("name", "first")
        last = names.select("doc", "row", F.col("line").alias("at"), F.col("name").alias("then"))
        sized = windows.filter(F.col("h").between(h, 2 * h - 1)).withColumn("at", F.col("line") + F.col("h") - h)
        keyed = sized.join(here, _PLACE).join(last, ["doc", "row", "at"])
        found.append(_named(keyed, ["h", "first", "then"], "h").filter(F.struct(*_PLACE) != F.col("name")).select(*_PLACE, "h"))
        if 2 * h > most or names.isEmpty():
            break
        names = cut(_doubled(names, h))
        h *= 2
    return reduce(DataFrame.union, found) if found else windows.limit(0)


def _joined(spans: DataFrame) -> DataFrame:
    """Spans (``doc, row, line, h``) joined where they overlap or meet, as sorted arrays ``gone`` of ``(line, past)`` for each document."""
    document = Window.partitionBy("doc", "row")
    order = document.orderBy("line", "h")
    reached = F.max(F.col("line") + F.col("h")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce((F.col("line") > reached).cast("int"), F.lit(1)))
    numbered = fresh.withColumn("nth", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = numbered.groupBy("doc", "row", "nth").agg(F.min("line").alias("line"), F.max(F.col("line") + F.col("h")).alias("past"))
    return joined.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("line", "past"))).alias("gone"))


def _run_masks(real: DataFrame, run: int) -> DataFrame:
    """``doc, row, n_gone, mask`` where runs are measured in lines."""
    starts = repeated_runs(real, run)
    gone = starts.select("doc", "row", F.explode(F.sequence("line", F.col("line") + (run - 1))).alias("line")).distinct()
    sorted_ = gone.groupBy("doc", "row").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    gap = F.transform("gone", lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.when(i == 0, F.lit(-1)).otherwise(F.get("gone", i - 1)) - 1), F.array(F.lit(True))))
    return sorted_.select("doc", "row", F.size("gone").alias("n_gone"), F.flatten(gap).alias("mask"))


def _span_masks(real: DataFrame, words: int) -> DataFrame:
    """``doc, row, n_gone, mask`` where runs are measured in words."""
    gap = F.transform("gone", lambda x, i: F.concat(F.array_repeat(F.lit(False), x["line"] - F.when(i == 0, F.lit(0)).otherwise(F.get("gone", i - 1)["past"])), F.array_repeat(F.lit(True), x["past"] - x["line"])))
    n_gone = F.aggregate("gone", F.lit(0), lambda n, x: n + x["past"] - x["line"])
    return _joined(repeated_spans(real, words)).select("doc", "row", n_gone.alias("n_gone"), F.flatten(gap).alias("mask"))


def line_dedup(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """Delete each line in a run of `run` or more lines that also stands earlier.

    With `words`, runs count from so many words on, whatever number of lines they
    have, and `run` is not used.

    Earlier: in a document with a smaller ``doc_id``, or further up in the same
    one.  Lines are parted by ``\\n``; blank lines count.  Lines are compared by two
    hashes (64 and 32 bits) and their length.
    Runs are judged on the input.  ``docs`` needs ``doc_id`` and ``text``; other
    columns are ignored.

    Returns one row per input row: ``doc_id, n_lines, n_removed, kept_text``.

    Null text: one empty line's worth of nothing, so 0 lines and an empty kept
    text.  An empty text has one empty line.  Rows with a null ``doc_id`` come
    after all others.  Rows that agree in ``doc_id`` and text count as one
    document (their lines are deleted alike); rows that share only the id are
    ordered by a hash of their text.  An empty table gives an empty result.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("row"), "text")
    real = keyed.filter("text is not null")
    slim = real.select("doc", "row", "text")
    masks = cut(_run_masks(slim, run) if words is None else _span_masks(slim, words))
    # texts are dealt by document whatever the masks' size, so that the plan is the same for any input
    joined = keyed.join(masks.hint("merge"), ["doc", "row"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get("mask", i), F.lit(False))), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.when(F.col("mask").isNull(), F.col("text")).otherwise(kept), F.lit("")).alias("kept_text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, runs of three lines or more."""
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_line_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, runs of twenty words or more, be it one line."""
    found = line_dedup(table(spark, sf_dir, "documents"), words=WORDS)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS content
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
runs AS (
  SELECT *, lead(content, 1) OVER w AS second, lead(content, 2) OVER w AS third, lead(line, 2) OVER w AS last
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
later AS (
  SELECT doc_id, line FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY content, second, third ORDER BY doc_id, line) AS nth FROM runs WHERE last IS NOT NULL)
  WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, line + s.i AS line FROM later, (VALUES (0), (1), (2)) AS s(i)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
         coalesce(string_agg(l.content, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
