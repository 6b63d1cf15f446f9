"""Speech-corpus tables derived from the driver's tables.

The driver has no recordings, so events stand for speaker turns (a day is a
recording, the event type a speaker), embeddings for voice prints and waveforms,
documents for transcripts.  Times are integer microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec, spk, turn_id, s_us, e_us``: who speaks when; turns of no length are dropped."""
    ts = F.col("ts")
    start = ((F.hour(ts) * 60 + F.minute(ts)) * 60 + F.second(ts)).cast("long") * 1_000_000 + F.date_format(ts, "SSSSSS").cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("turn_id"), F.to_date(ts).cast("string").alias("rec"), F.col("event_type").alias("spk"), start.alias("s_us"), F.round(F.col("value") * 1e6).cast("long").alias("len_us"))
    return rows.filter("len_us > 0").select("rec", "spk", "turn_id", "s_us", (F.col("s_us") + F.col("len_us")).alias("e_us"))


TURNS_SQL = """turns AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS rec, event_type AS spk, event_id AS turn_id,
         epoch_us(ts) % 86400000000 AS s_us, epoch_us(ts) % 86400000000 + CAST(round(value * 1e6) AS BIGINT) AS e_us
  FROM events WHERE CAST(round(value * 1e6) AS BIGINT) > 0)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate clips: a document's text as transcript, its length as duration, its label as verification."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flags = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(flags, "doc_id", "left").select(
        F.format_string("clip-%08d", "doc_id").alias("clip_id"),
        F.col("text").alias("transcript"),
        F.col("source").alias("speaker"),
        F.col("lang").alias("language"),
        (F.length("text").cast("long") * 10_000).alias("dur_us"),
        (F.col("doc_id") % 10 != 0).alias("silence_validated"),
        F.coalesce(F.col("quality") == 1, F.lit(True)).alias("verified"),
        "doc_id",
    )


CLIPS_SQL = """clips AS (
  SELECT printf('clip-%08d', d.doc_id) AS clip_id, d.text AS transcript, d.source AS speaker, d.lang AS language,
         CAST(length(d.text) AS BIGINT) * 10000 AS dur_us, d.doc_id % 10 <> 0 AS silence_validated,
         coalesce(l.quality = 1, true) AS verified, d.doc_id
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, v`` with v an array of doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, pos, x``: vectors read as waveforms, one sample a row."""
    return vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("pos", "x"))


SAMPLES_SQL = """samples AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""
