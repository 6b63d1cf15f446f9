"""Operator 12: license scan by ordered signature rules.

A text becomes its words in lower case, each with a space before and behind, so
that a pattern over words neither needs look-around nor shares a space with its
neighbour.  Keywords that occur in the text choose the rules that are tried on it
at all.  Every place of a rule is an interval of words.  A detection goes if an
interval of a rule with the same or a better level contains it and stands before
it in order (start, longer first, level, rule): with the intervals so sorted, that
is a running maximum of ends for each level.

All of it is one projection: no row leaves its task, no text is copied to another
row, and sums and maxima over a document's intervals take n log n steps, so one
text with a million detections ends too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.frames import hidden, table
from quillon.llm.license_rules import Rule, rules, spaced

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What a detection of a level is worth.
WORTH = [1.0, 0.9, 0.7, 0.4]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima) of an array by doubling the span that is joined."""
    spans = F.array(*[F.lit(1 << j) for j in range(31)])

    def joined(acc: Column, s: Column) -> Column:
        return F.when(s < F.size(acc), F.transform(acc, lambda x, i: F.when(i >= s, join(x, F.get(acc, i - s))).otherwise(x))).otherwise(acc)

    return F.aggregate(spans, values, joined)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, even where `use` reads it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_text(text: str = "text") -> Column:
    """The words of a text in lower case (A-Z only), each with a space before and behind; null and empty texts have none."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    inner = F.trim(F.regexp_replace(lower, NOT_WORD, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def count_words(said: Column) -> Column:
    """Words of a text that `words_text` made, or of whole words of it."""
    return (F.octet_length(said) - F.octet_length(F.replace(said, F.lit(" "), F.lit("")))).cast("int") / 2


def _rule_array(chosen: list[Rule]) -> Column:
    """The rules as one literal."""
    return F.array(*[F.struct(F.lit(r.level).alias("level"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(spaced(r.pattern)).alias("pattern"), F.lit(r.base).alias("base"), F.lit(i).alias("rule")) for i, r in enumerate(chosen)])


def _intervals(said: Column, rule: Column) -> Column:
    """All places of a rule: ``start`` and ``stop`` (exclusive) in words; `shorter` sorts longer ones first."""
    between = F.transform(F.split(said, rule["pattern"]), lambda s: count_words(s).cast("int"))

    def placed(inside: Column) -> Column:
        ends = running(F.zip_with(F.slice(between, 1, F.size(inside)), inside, lambda a, b: a + b), lambda a, b: a + b)
        return F.zip_with(
            ends, inside, lambda e, n: F.struct((e - n).alias("start"), (-e).alias("shorter"), rule["level"].alias("level"), rule["rule"].alias("rule"), e.alias("stop"), rule["label"].alias("label"), rule["base"].alias("base"))
        )

    return bound(F.transform(F.regexp_extract_all(said, rule["pattern"], F.lit(0)), lambda s: count_words(s).cast("int")), placed)


def _reach(found: Column, levels: int) -> Column:
    """For each level the furthest end, up to each of the sorted detections, of those with that level or a better one."""

    def upto(level: int) -> Column:
        ends = F.transform(found, lambda d: F.when(d["level"] <= level, d["stop"]).otherwise(F.lit(-1)))
        return running(ends, lambda a, b: F.greatest(a, b))

    return F.array(*[upto(level) for level in range(levels)])


NEW = ["n_words", "detections"]


def detect(docs: DataFrame, chosen: list[Rule] | None = None) -> DataFrame:
    """Adds the license detections of every text.

    ``docs`` needs ``text``; all its columns stay, whatever their names, but for
    those named like the new ones, which are replaced: ``n_words`` and
    ``detections``, an array of ``start, stop, level, rule, label, base, kept``
    (words from 0, stop exclusive) in order of place; ``kept`` says that no other
    detection suppresses it.  Words are runs of letters, digits and characters
    beyond ASCII.

    Null and empty texts have no words and no detections.  Equal rows get equal
    values; an empty table gives an empty result.
    """
    chosen = rules() if chosen is None else chosen
    levels = max((r.level for r in chosen), default=0) + 1
    every = _rule_array(chosen)
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in chosen})])
    plain, back = hidden(docs.drop(*NEW), ["text"])
    said = F.col("said_")
    # one step a projection: what a step makes is read several times by the next
    worded = plain.withColumn("said_", words_text())
    keyed = worded.withColumn("keywords_", F.filter(keywords, lambda k: F.contains(said, k)))
    tried = keyed.withColumn("tried_", F.when(F.size("keywords_") > 0, F.filter(every, lambda r: F.array_contains("keywords_", r["keyword"]) & F.rlike(said, r["pattern"]))))
    found = tried.withColumn("found_", F.array_sort(F.flatten(F.transform(F.coalesce("tried_", F.slice(every, 1, 0)), lambda r: _intervals(said, r)))))

    def judged(reach: Column) -> Column:
        suppressed = lambda d, i: (i > 0) & (F.get(F.get(reach, d["level"]), i - 1) >= d["stop"])
        return F.transform(
            "found_", lambda d, i: F.struct(d["start"].alias("start"), d["stop"].alias("stop"), d["level"].alias("level"), d["rule"].alias("rule"), d["label"].alias("label"), d["base"].alias("base"), (~suppressed(d, i)).alias("kept"))
        )

    shown = bound(_reach(F.col("found_"), levels), judged)
    return found.select(*back, count_words(said).cast("long").alias("n_words"), shown.alias("detections"))


def labels_of(detections: Column) -> Column:
    """Distinct labels, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: licenses of all documents; the score is the worth of the best kept detection."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    kept = F.filter("detections", lambda d: d["kept"])
    best = F.array_min(F.transform(kept, lambda d: d["level"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels_of(base).alias("base_labels"), labels_of(F.filter("detections", lambda d: d["base"] | d["kept"])).alias("labels"),
        F.coalesce(F.get(F.array(*[F.lit(w) for w in WORTH]), best), F.lit(0.0)).alias("score"), F.size("detections").cast("long").alias("n_detections"), F.size(kept).cast("long").alias("n_kept"),
    )


def _op12_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table_of = ", ".join(f"({r.level}, {i}, {quoted(r.label)}, {str(r.base).lower()}, {quoted(r.keyword)}, {quoted(spaced(r.pattern))})" for i, r in enumerate(rules()))
    worth = " ".join(f"when {i} then {w}" for i, w in enumerate(WORTH))
    return f"""
with signature(level, rule, label, base, keyword, pattern) as (values {table_of}),
worded as materialized (select row_number() over () as row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
said as materialized (select row_id, doc_id, len(words) as n_words, array_to_string([' ' || w || ' ' for w in words], '') as said from worded),
hit as materialized (select row_id, said, s.* from said, signature s where case when contains(said, s.keyword) then regexp_matches(said, s.pattern) else false end),
cut as (select row_id, level, rule, label, base, string_split_regex(said, pattern) as between_, regexp_extract_all(said, pattern) as inside_ from hit),
piece as (select row_id, level, rule, label, base, unnest(range(1, len(inside_) + 1)) as i, (len(between_[i]) - len(replace(between_[i], ' ', ''))) // 2 as before_, (len(inside_[i]) - len(replace(inside_[i], ' ', ''))) // 2 as n from cut),
place as (select *, sum(before_ + n) over (partition by row_id, rule order by i) as stop from piece),
found as materialized (select row_id, level, rule, label, base, stop - n as start, stop from place),
judged as (select a.*, exists (select 1 from found b where b.row_id = a.row_id and b.rule <> a.rule and b.level <= a.level and b.start <= a.start and b.stop >= a.stop and (b.start < a.start or b.stop > a.stop or b.level < a.level or b.rule < a.rule)) as gone from found a),
summed as (
  select row_id, count(*) filter (base) as n_base, cast(min(start) filter (base) as bigint) as first_word, cast(max(start) filter (base) as bigint) as last_word, coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label) filter (base or not gone), '') as labels,
    case min(level) filter (not gone) {worth} end as score, count(*) as n_detections, count(*) filter (not gone) as n_kept
  from judged group by row_id)
select doc_id, cast(n_words as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(coalesce(score, 0.0) as double) as score, coalesce(n_detections, 0) as n_detections, coalesce(n_kept, 0) as n_kept
from said left join summed using (row_id)"""


OP12_SQL = _op12_sql()
