"""Registered interval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import intervals as iv
from quillon.plans.domain import DAY_US, TURNS_SQL, table, turns

TARGET = "click"
HOUR_US = 3_600_000_000

#: Islands of spans of `{src}` under keys `{keys}`, joined over `{gap}`: CTEs `{out}_o` and `{out}`.
_ISLANDS = """{out}_o AS (
  SELECT *, CASE WHEN s_us <= max(e_us) OVER (PARTITION BY {keys} ORDER BY s_us, e_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS opens FROM {src}),
{out} AS (
  SELECT {keys}, min(s_us) AS s_us, max(e_us) AS e_us, count(*) AS n FROM (
    SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY s_us, e_us ROWS UNBOUNDED PRECEDING) AS island FROM {out}_o)
  GROUP BY {keys}, island)"""


def islands(src: str, out: str, keys: str, gap: int = 0) -> str:
    return _ISLANDS.format(src=src, out=out, keys=keys, gap=gap)


_OVERLAP = f"""{TURNS_SQL},
{islands("turns", "own", "rec, spk")},
marks AS (SELECT rec, s_us AS t, 1 AS d FROM own UNION ALL SELECT rec, e_us, -1 FROM own),
instants AS (SELECT rec, t, sum(d) AS d FROM marks GROUP BY rec, t),
depth AS (SELECT rec, t AS s_us, lead(t) OVER w AS e_us, sum(d) OVER w AS depth FROM instants WINDOW w AS (PARTITION BY rec ORDER BY t)),
deep AS (SELECT rec, s_us, e_us FROM depth WHERE depth >= 2 AND e_us IS NOT NULL),
{islands("deep", "ov", "rec")}"""

_SOLO = f"""{_OVERLAP},
mine AS (SELECT * FROM turns WHERE spk = '{TARGET}'),
{islands("mine", "target", "rec", iv.GAP_US)},
marks2 AS (
  SELECT rec, s_us AS t, 1 AS a, 0 AS b FROM target UNION ALL SELECT rec, e_us, -1, 0 FROM target
  UNION ALL SELECT rec, s_us, 0, 1 FROM ov UNION ALL SELECT rec, e_us, 0, -1 FROM ov),
instants2 AS (SELECT rec, t, sum(a) AS a, sum(b) AS b FROM marks2 GROUP BY rec, t),
open2 AS (SELECT rec, t AS s_us, lead(t) OVER w AS e_us, sum(a) OVER w AS a, sum(b) OVER w AS b FROM instants2 WINDOW w AS (PARTITION BY rec ORDER BY t)),
alone AS (SELECT rec, s_us, e_us FROM open2 WHERE a > 0 AND b = 0 AND e_us IS NOT NULL),
{islands("alone", "solo", "rec")}"""

_SPEECH = f"{TURNS_SQL},\n{islands('turns', 'speech', 'rec')}"
_HOURS = "hours AS (SELECT DISTINCT rec, h AS region_id, h * 3600000000 AS s_us, (h + 1) * 3600000000 AS e_us FROM turns, range(24) AS x(h))"


def _speech(spark, d):
    return iv.union(turns(spark, d), ["rec"]).select("rec", "s_us", "e_us")


def _hours(spark, d):
    recs = turns(spark, d).select("rec").distinct()
    return recs.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("region_id")).select("rec", "region_id", (F.col("region_id") * HOUR_US).alias("s_us"), ((F.col("region_id") + 1) * HOUR_US).alias("e_us"))


def int_filter_duration(spark, d):
    return iv.at_least(turns(spark, d), 30_000_000).select("rec", "spk", "turn_id", "s_us", "e_us")


def int_union_gap(spark, d):
    return iv.union(turns(spark, d), ["rec", "spk"], iv.GAP_US)


def int_session_union(spark, d):
    return iv.session_union(turns(spark, d), ["rec", "spk"], iv.GAP_US)


def int_support(spark, d):
    return iv.union(turns(spark, d), ["rec"])


def int_overlap(spark, d):
    return iv.overlap(turns(spark, d))


def int_solo(spark, d):
    return iv.solo(turns(spark, d), TARGET)


def int_complement(spark, d):
    return iv.complement(turns(spark, d), ["rec"], DAY_US)


def int_pad_clamp(spark, d):
    return iv.padded(turns(spark, d), 150_000, DAY_US).select("rec", "spk", "turn_id", "s_us", "e_us")


def int_clip_to_region(spark, d):
    return iv.clip_to_regions(_speech(spark, d), _hours(spark, d), ["rec"])


def int_snap_edges(spark, d):
    return iv.snap_outward(_hours(spark, d), _speech(spark, d), ["rec"], DAY_US)


def int_point_in_span(spark, d):
    points = _hours(spark, d).select("rec", "region_id", F.col("s_us").alias("t_us"))
    return iv.points_inside(points, _speech(spark, d), ["rec"])


def int_speech_ratio(spark, d):
    return iv.speech_ratio(iv.clamp(turns(spark, d), DAY_US), ["rec"], DAY_US).select("rec", "speech_us", F.round("ratio", 6).alias("ratio"))


def int_timeline_duration(spark, d):
    return iv.duration(turns(spark, d), ["rec", "spk"])


def _doc_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.length("text").cast("long") * 10_000).alias("dur_us"))


def int_chunk_cover(spark, d):
    return iv.chunk_cover(_doc_lengths(spark, d), ["doc_id"], "dur_us", 60_000_000)


def int_equal_split(spark, d):
    return iv.equal_split(_doc_lengths(spark, d).select("doc_id", F.lit(0).cast("long").alias("s_us"), F.col("dur_us").alias("e_us")), ["doc_id"], 12_000_000, 4_000_000)


def int_tiles(spark, d):
    return iv.tiles(_doc_lengths(spark, d).select("doc_id", F.lit(0).cast("long").alias("s_us"), F.col("dur_us").alias("e_us")), ["doc_id"], 12_000_000, 4_000_000)


def int_pair_overlap_join(spark, d):
    own = iv.union(turns(spark, d), ["rec", "spk"]).select("rec", "spk", "s_us", "e_us")
    met = iv.range_join(own, own, "rec", 60_000_000).filter("l_spk < r_spk")
    return met.select(F.col("l_rec").alias("rec"), "l_spk", "r_spk", "l_s_us", "r_s_us", (F.least("l_e_us", "r_e_us") - F.greatest("l_s_us", "r_s_us")).alias("both_us"))


def int_voiced_overlap(spark, d):
    return iv.overlap_of_windows(_hours(spark, d), turns(spark, d), ["rec"])


def int_offset_merge(spark, d):
    hours = _hours(spark, d).select("rec", F.col("region_id").alias("chunk_no"), "s_us")
    local = turns(spark, d).withColumn("chunk_no", F.floor(F.col("s_us") / HOUR_US)).withColumns({"s_us": F.col("s_us") % HOUR_US, "e_us": F.col("e_us") - F.floor(F.col("s_us") / HOUR_US) * HOUR_US})
    return iv.offset_merge(local, hours, ["rec"]).select("rec", "spk", "turn_id", "s_us", "e_us")


QUERIES = {f.__name__: f for f in (int_filter_duration, int_union_gap, int_session_union, int_support, int_overlap, int_solo, int_complement, int_pad_clamp, int_clip_to_region, int_snap_edges, int_point_in_span, int_speech_ratio, int_timeline_duration, int_chunk_cover, int_equal_split, int_tiles, int_pair_overlap_join, int_voiced_overlap, int_offset_merge)}

_UNION = f"WITH {TURNS_SQL},\n{islands('turns', 'u', 'rec, spk', iv.GAP_US)} SELECT rec, spk, s_us, e_us, n FROM u"
_LENGTHS = "lengths AS (SELECT doc_id, CAST(length(text) AS BIGINT) * 10000 AS dur FROM documents WHERE text IS NOT NULL)"

ORACLE_SQL = {
    "int_filter_duration": f"WITH {TURNS_SQL} SELECT rec, spk, turn_id, s_us, e_us FROM turns WHERE e_us - s_us >= 30000000",
    "int_union_gap": _UNION,
    "int_session_union": _UNION,
    "int_support": f"WITH {_SPEECH} SELECT rec, s_us, e_us, n FROM speech",
    "int_overlap": f"WITH {_OVERLAP} SELECT rec, s_us, e_us FROM ov",
    "int_solo": f"WITH {_SOLO} SELECT rec, s_us, e_us FROM solo",
    "int_complement": f"""WITH {TURNS_SQL}, cut AS (SELECT rec, s_us, least(e_us, {DAY_US}) AS e_us FROM turns WHERE least(e_us, {DAY_US}) > s_us),
{islands("cut", "held", "rec")},
free AS (SELECT rec, coalesce(lag(e_us) OVER (PARTITION BY rec ORDER BY s_us), 0) AS s_us, s_us AS e_us FROM held
  UNION ALL SELECT rec, max(e_us), {DAY_US} FROM held GROUP BY rec)
SELECT rec, s_us, e_us FROM free WHERE e_us > s_us""",
    "int_pad_clamp": f"WITH {TURNS_SQL}, p AS (SELECT rec, spk, turn_id, greatest(s_us - 150000, 0) AS s_us, least(e_us + 150000, {DAY_US}) AS e_us FROM turns) SELECT * FROM p WHERE e_us > s_us",
    "int_clip_to_region": f"WITH {_SPEECH}, {_HOURS} SELECT s.rec, region_id, greatest(s.s_us, h.s_us) - h.s_us AS s_us, least(s.e_us, h.e_us) - h.s_us AS e_us FROM speech s JOIN hours h ON s.rec = h.rec AND s.s_us < h.e_us AND h.s_us < s.e_us",
    "int_snap_edges": f"""WITH {_SPEECH}, {_HOURS},
snapped AS (SELECT h.rec, region_id, least(h.s_us, coalesce(min(s.s_us) FILTER (WHERE s.s_us - 1000 < h.s_us AND h.s_us < s.e_us + 1000), h.s_us)) AS a,
  greatest(h.e_us, coalesce(max(s.e_us) FILTER (WHERE s.s_us - 1000 < h.e_us AND h.e_us < s.e_us + 1000), h.e_us)) AS b
  FROM hours h LEFT JOIN speech s ON h.rec = s.rec GROUP BY h.rec, region_id, h.s_us, h.e_us)
SELECT rec, region_id, greatest(a, 0) AS s_us, least(b, {DAY_US}) AS e_us FROM snapped WHERE least(b, {DAY_US}) > greatest(a, 0)""",
    "int_point_in_span": f"WITH {_SPEECH}, {_HOURS} SELECT h.rec, region_id, h.s_us AS t_us FROM hours h WHERE EXISTS (SELECT 1 FROM speech s WHERE s.rec = h.rec AND s.s_us + 10000 < h.s_us AND h.s_us < s.e_us - 10000)",
    "int_speech_ratio": f"WITH {TURNS_SQL}, s AS (SELECT rec, CAST(sum(greatest(least(e_us, {DAY_US}) - s_us, 0)) AS BIGINT) AS speech_us FROM turns GROUP BY rec) SELECT rec, speech_us, round(least(1.0, greatest(0.0, speech_us / {DAY_US})), 6) AS ratio FROM s",
    "int_timeline_duration": f"WITH {TURNS_SQL}, {islands('turns', 'u', 'rec, spk')} SELECT rec, spk, CAST(sum(e_us - s_us) AS BIGINT) AS covered_us, count(*) AS islands FROM u GROUP BY rec, spk",
    "int_chunk_cover": f"WITH {_LENGTHS}, c AS (SELECT doc_id, dur, unnest(range(0, dur, 60000000)) AS s_us FROM lengths WHERE dur > 0) SELECT doc_id, CAST(s_us // 60000000 AS INT) AS chunk_no, s_us, least(s_us + 60000000, dur) AS e_us FROM c",
    "int_equal_split": f"""WITH {_LENGTHS}, p AS (SELECT doc_id, dur, greatest(1, CAST(ceil(dur / 12000000) AS INT)) AS parts FROM lengths),
x AS (SELECT doc_id, dur, parts, unnest(range(0, parts)) AS part FROM p),
y AS (SELECT doc_id, CAST(part AS INT) AS part, CAST(round(dur * part / parts / 1000) AS BIGINT) * 1000 AS s_us, CAST(round(dur * (part + 1) / parts / 1000) AS BIGINT) * 1000 AS e_us FROM x)
SELECT * FROM y WHERE e_us - s_us >= 4000000""",
    "int_tiles": f"WITH {_LENGTHS}, t AS (SELECT doc_id, dur, unnest(range(0, dur - 4000000 + 1, 12000000)) AS s_us FROM lengths WHERE dur >= 4000000) SELECT doc_id, CAST(s_us // 12000000 AS INT) AS tile, s_us, least(s_us + 12000000, dur) AS e_us FROM t",
    "int_pair_overlap_join": f"WITH {TURNS_SQL}, {islands('turns', 'u', 'rec, spk')} SELECT l.rec, l.spk AS l_spk, r.spk AS r_spk, l.s_us AS l_s_us, r.s_us AS r_s_us, least(l.e_us, r.e_us) - greatest(l.s_us, r.s_us) AS both_us FROM u l JOIN u r ON l.rec = r.rec AND l.spk < r.spk AND l.s_us < r.e_us AND r.s_us < l.e_us",
    "int_voiced_overlap": f"WITH {TURNS_SQL}, {_HOURS} SELECT h.rec, region_id, h.s_us, h.e_us, CAST(coalesce(sum(least(t.e_us, h.e_us) - greatest(t.s_us, h.s_us)) FILTER (WHERE t.s_us IS NOT NULL), 0) AS BIGINT) AS voiced_us FROM hours h LEFT JOIN turns t ON h.rec = t.rec AND t.s_us < h.e_us AND h.s_us < t.e_us GROUP BY ALL",
    "int_offset_merge": f"WITH {TURNS_SQL} SELECT rec, spk, turn_id, s_us, e_us FROM turns",
}
