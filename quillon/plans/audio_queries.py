"""Registered signal and sink queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import audio as au
from quillon.plans.domain import SAMPLES_SQL, TURNS_SQL, samples, table, turns, vectors
from quillon.plans.text_queries import ORACLE_SQL as TEXT_SQL
from quillon.sources import readers as rd
from quillon.sources import sinks as si


def aud_gain(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") / -250).alias("lufs"), (F.col("c_custkey") % 50 * 20_000).alias("dur_us"), (F.col("c_custkey") % 30 - 25.0).alias("tp"))
    gain = au.gain_db(F.col("lufs"), F.col("dur_us"), -23.0)
    return rows.select("c_custkey", F.round(gain, 6).alias("gain_db"), F.round(au.limited_scale(gain, F.col("tp")), 6).alias("scale"))


def aud_resample(spark, d):
    return au.resampled(samples(spark, d), "vec_id", 16_000, 22_050).select("vec_id", "pos", F.round("x", 6).alias("x"))


def aud_mono(spark, d):
    rows = vectors(spark, d).withColumn("m", au.mono(F.slice("v", 1, 32), F.slice("v", 33, 32)))
    return rows.select("vec_id", F.posexplode("m").alias("pos", "x"))


def aud_bandwidth(spark, d):
    waves = vectors(spark, d).select("vec_id", F.col("v").alias("samples"))
    return au.bandwidth(waves, "vec_id", 16_000, frame=32, hop=8)


def aud_reel(spark, d):
    clips = turns(spark, d).select("rec", "s_us", F.col("turn_id").alias("clip_id"), (F.col("e_us") - F.col("s_us")).alias("dur_us"))
    return au.reel(clips, ["rec"], 500_000).select("rec", "clip_id", "nth", "offset_us")


def aud_wav_round_trip(spark, d):
    """Samples through 16-bit sound files and back: the greatest difference of each vector is within a step."""
    waves = vectors(spark, d).select("vec_id", F.transform("v", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))).alias("v"))
    stored = waves.withColumn("wav", si.wav_column(16_000)("v"))

    def back(batches):
        for batch in batches:
            read = [rd.wav_samples(bytes(w)) for w in batch["wav"]]
            batch["rate"] = [r[0] for r in read]
            batch["worst"] = [float(abs(r[1] - v).max()) for r, v in zip(read, batch["v"], strict=True)]
            yield batch[["vec_id", "rate", "worst"]]

    return stored.mapInPandas(back, "vec_id long, rate int, worst double").select("vec_id", "rate", (F.col("worst") < 1e-4).alias("same"))


def snk_transcript_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 1_234_567).alias("s_us"), (F.col("doc_id") * 1_234_567 + F.length("text").cast("long") * 10_000).alias("e_us"), F.concat("source", F.lit(".wav")).alias("filename"), F.col("text").alias("transcript"))
    return rows.select("doc_id", si.transcript_line().alias("line"), si.transcript_block().alias("block"))


def snk_layout(spark, d):
    base = tx.segment_name(F.col("turn_id") % 100000, F.col("s_us"), F.col("e_us"))
    return turns(spark, d).select("turn_id", si.layout(base, F.lit("t"), F.col("turn_id") % 3 == 0, F.col("turn_id") % 8 / 8).alias("path"))


def snk_free_names(spark, d):
    return si.free_names(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id").select("doc_id", "name")


def snk_clipboard(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("clip_id"), F.col("text").alias("transcript"))
    return rows.select("doc_id", si.clipboard_line().alias("line"))


QUERIES = {f.__name__: f for f in (aud_gain, aud_resample, aud_mono, aud_bandwidth, aud_reel, aud_wav_round_trip, snk_transcript_lines, snk_layout, snk_free_names, snk_clipboard)}

_LINE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_FIELD = """CASE WHEN regexp_matches({c}, '[,"\\r\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""
_SEC = "printf('%d.%03d', ({t} + 500) // 1000 // 1000, ({t} + 500) // 1000 % 1000)"
_CLOCK = "printf('%02d:%02d:%02d.%03d', {t} // 3600000000, {t} // 60000000 % 60, {t} // 1000000 % 60, {t} // 1000 % 1000)"
_NAMED = TEXT_SQL["txt_basename"].split(" SELECT turn_id, base")[0]

#: The transform of 32 padded samples every 8, as sums of cosines and sines.
_BANDWIDTH = """framed AS (SELECT e.vec_id, f, n, coalesce(CASE WHEN f * 8 + n - 16 BETWEEN 0 AND 63 THEN CAST(embedding[f * 8 + n - 15] AS DOUBLE) END, 0) * (0.5 - 0.5 * cos(2 * pi() * n / 32)) AS x FROM embeddings e, range(9) AS a(f), range(32) AS b(n)),
bins AS (SELECT vec_id, f, k, sqrt(pow(sum(x * cos(2 * pi() * k * n / 32)), 2) + pow(sum(x * sin(2 * pi() * k * n / 32)), 2)) AS p FROM framed, range(17) AS c(k) GROUP BY vec_id, f, k),
grown AS (SELECT vec_id, f, k, sum(p) OVER (PARTITION BY vec_id, f ORDER BY k) AS upto, sum(p) OVER (PARTITION BY vec_id, f) AS total FROM bins),
rolled AS (SELECT vec_id, f, min(k) AS k FROM grown WHERE upto >= 0.99 * total GROUP BY vec_id, f)"""

ORACLE_SQL = {
    "aud_bandwidth": f"WITH {_BANDWIDTH}, m AS (SELECT vec_id, quantile_cont(k, 0.5) * 16000 / 32 AS rolloff_hz FROM rolled GROUP BY vec_id) SELECT vec_id, rolloff_hz, rolloff_hz < 6000 AS limited FROM m",
    "aud_gain": """WITH g AS (SELECT c_custkey, c_custkey % 30 - 25.0 AS tp, CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 50 * 20000 >= 400000 THEN least(12.0, greatest(-12.0, -23.0 - c_acctbal / -250)) ELSE 0.0 END AS gain FROM customer)
SELECT c_custkey, round(gain, 6) AS gain_db, round(pow(10.0, (gain - CASE WHEN gain = 0 THEN 0 ELSE greatest(0, tp + gain + 1) END) / 20), 6) AS scale FROM g""",
    "aud_resample": f"""WITH {SAMPLES_SQL}, o AS (SELECT vec_id, unnest(range(88)) AS pos FROM embeddings),
p AS (SELECT vec_id, pos, pos * (64 / 88) AS t FROM o)
SELECT p.vec_id, p.pos, round(a.x + (coalesce(b.x, a.x) - a.x) * (t - floor(t)), 6) AS x FROM p
JOIN samples a ON a.vec_id = p.vec_id AND a.pos = CAST(floor(t) AS BIGINT) LEFT JOIN samples b ON b.vec_id = p.vec_id AND b.pos = CAST(floor(t) AS BIGINT) + 1""",
    "aud_mono": f"WITH {SAMPLES_SQL} SELECT a.vec_id, a.pos, (a.x + b.x) / 2 AS x FROM samples a JOIN samples b ON a.vec_id = b.vec_id AND b.pos = a.pos + 32 WHERE a.pos < 32",
    "aud_reel": f"WITH {TURNS_SQL}, n AS (SELECT rec, turn_id AS clip_id, row_number() OVER w - 1 AS nth, coalesce(sum(e_us - s_us) OVER (PARTITION BY rec ORDER BY s_us, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turns WINDOW w AS (PARTITION BY rec ORDER BY s_us, turn_id)) SELECT rec, clip_id, nth, CAST(before + nth * 500000 AS BIGINT) AS offset_us FROM n",
    "aud_wav_round_trip": "SELECT vec_id, 16000 AS rate, true AS same FROM embeddings",
    "snk_transcript_lines": f"WITH r AS (SELECT doc_id, doc_id * 1234567 AS s, doc_id * 1234567 + length(text) * 10000 AS e, source || '.wav' AS f, {_LINE} AS line FROM documents) SELECT doc_id, {_SEC.format(t='s')} || ',' || {_SEC.format(t='e')} || ',' || {_SEC.format(t='(e - s)')} || ',' || {_FIELD.format(c='f')} || ',' || {_FIELD.format(c='line')} AS line, '[' || {_CLOCK.format(t='s')} || ' --> ' || {_CLOCK.format(t='e')} || '] ' || line AS block FROM r",
    "snk_layout": f"{_NAMED} SELECT turn_id, CASE WHEN turn_id % 3 = 0 THEN 'verified/' || replace(base, 'solo_temp_verif', 't_solo_final') || '.wav' ELSE 'rejected/' || replace(base, 'solo_temp_verif', 't_solo_final') || printf('_score_%.3f', turn_id % 8 / 8) || '.wav' END AS path FROM named",
    "snk_free_names": "WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS nth FROM documents) SELECT doc_id, source || CASE WHEN nth = 0 THEN '' ELSE '_' || nth END AS name FROM n",
    "snk_clipboard": f"SELECT doc_id, source || '|' || {_LINE} || '|' || source || '.wav' AS line FROM documents",
}
