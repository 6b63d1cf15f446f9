"""Registered queries of the detector's post-processing and their SQL.

A label's vectors, one after another, stand for the frame probabilities of a
recording: five times a component's size, in steps of 1/1024, at most 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import detector as dt
from quillon.plans.domain import table

#: Vectors are short recordings, so runs are asked for in fewer frames than on real ones.
SHORT = dt.Settings(least_speech=12, least_silence=4, most_speech=60, merge_silence=2, extend=3, block=300)


def _frames(spark, d):
    vectors = table(spark, d, "embeddings").filter("label is not null")
    rows = vectors.select("label", "vec_id", F.posexplode("embedding").alias("pos", "x"))
    p = F.least(F.lit(1.0), F.floor(F.abs(F.col("x").cast("double")) * 5 * 1024) / 1024)
    return rows.select("label", (F.col("vec_id") * 64 + F.col("pos")).alias("frame"), p.alias("p"))


def _rounded(spans):
    # means are multiples of a small step, so halves of the last place are common: they go up on both sides
    return spans.withColumn("mean_p", F.round(F.col("mean_p") + 1e-9, 6))


def det_spans(spark, d):
    return _rounded(dt.spans(_frames(spark, d), "label", SHORT))


def det_spans_default(spark, d):
    return _rounded(dt.spans(_frames(spark, d), "label"))


QUERIES = {f.__name__: f for f in (det_spans, det_spans_default)}


def _sql(s: dt.Settings) -> str:
    return f"""
with frames as (
  select label, vec_id * 64 + pos - 1 as frame, least(1.0::double, floor(abs(x::double) * 5 * 1024) / 1024) as p
  from (select label, vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings where label is not null)),
smooth as (select label, frame, avg(p) over (partition by label order by frame range between {s.smooth - 1} preceding and current row) as p from frames),
flagged as (select *, p >= {s.threshold} as flag, lag(p >= {s.threshold}) over w as pf, lag(frame) over w as pr from smooth window w as (partition by label order by frame)),
numbered as (select *, sum(case when pf = flag and pr = frame - 1 then 0 else 1 end) over (partition by label order by frame) as run from flagged),
runs as (select label, run, min(frame) as first, max(frame) + 1 as past, bool_and(flag) as flag, sum(p) as total, count(*) as n from numbered group by label, run),
kinds as (select *, last_value(case when n >= case when flag then {s.least_speech} else {s.least_silence} end then flag end ignore nulls) over (partition by label order by first rows unbounded preceding) as state from runs),
speech as (select *, lag(past) over (partition by label order by first) as before from kinds where state),
islands as (select *, sum(case when first - before <= {s.merge_silence + 2 * s.extend} then 0 else 1 end) over (partition by label order by first rows unbounded preceding) as island from speech),
whole as (select label, island, min(first) as first, max(past) as past, sum(total) / sum(n) as mean_p from islands group by label, island),
grown as (select w.label, greatest(first - {s.extend}, 0) as a, least(past + {s.extend}, n) as z, mean_p from whole w join (select label, max(frame) + 1 as n from frames group by label) l using (label)),
parts as (select *, cast(ceil((z - a) / {s.most_speech}.0) as bigint) as k from grown),
cut as (select *, unnest(range(0, k)) as part from parts)
select label, a + (z - a) * part // k as first, a + (z - a) * (part + 1) // k as past, cast(part as int) as part, (a + (z - a) * part // k) * {s.frame_us} as s_us, (a + (z - a) * (part + 1) // k) * {s.frame_us} as e_us, round(mean_p + 1e-9, 6) as mean_p
from cut"""


ORACLE_SQL = {"det_spans": _sql(SHORT), "det_spans_default": _sql(dt.Settings())}
