"""Registered queries of the sound file source and sink, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.domain import table
from quillon.plans.shared import shared_path
from quillon.sources import sound_files as sf

RATE, HELD = 16_000, 4


def _written(spark, d):
    """Every vector as a sound file, each component held for some samples, in two jobs that are both committed."""
    sf.install(spark)
    path = shared_path(spark, "sounds")
    held = F.flatten(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.array_repeat(x, HELD)))
    rows = table(spark, d, "embeddings").select("vec_id", F.format_string("v%08d.wav", "vec_id").alias("name"), F.lit(RATE).alias("rate"), held.alias("samples"))
    for half in (F.col("vec_id") % 2 == 0, F.col("vec_id") % 2 != 0):
        rows.filter(half).drop("vec_id").write.format("quillon_sound").mode("append").save(path)
    return path


def _id(path):
    return F.regexp_extract(path, r"v(\d+)\.wav$", 1).cast("long")


def src_sound_headers(spark, d):
    """Lengths from the headers of all files; a header takes less than 4 KB to read."""
    rows = spark.read.format("quillon_sound").option("read", "headers").load(_written(spark, d))
    return rows.select(_id("path").alias("vec_id"), "rate", "channels", "frames", "dur_us", (F.col("bytes_read") < 4096).alias("little_read"))


def src_sound_blocks(spark, d):
    """Blocks of 100 samples of all files, read in parts of 200 bytes: samples and their sum in 16-bit steps."""
    rows = spark.read.format("quillon_sound").option("block", "100").option("partbytes", "200").load(_written(spark, d))
    steps = F.transform("samples", lambda x: F.bround(x.cast("double") * 32768).cast("long"))
    return rows.select(_id("path").alias("vec_id"), "block", "begin", F.size("samples").cast("long").alias("n"), F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


QUERIES = {f.__name__: f for f in (src_sound_headers, src_sound_blocks)}

ORACLE_SQL = {
    "src_sound_headers": f"SELECT vec_id, {RATE} AS rate, 1 AS channels, len(embedding) * {HELD} AS frames, len(embedding) * {HELD} * 1000000 // {RATE} AS dur_us, true AS little_read FROM embeddings",
    "src_sound_blocks": f"""WITH x AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1) AS i, unnest(embedding) AS v FROM embeddings),
s AS (SELECT vec_id, i * {HELD} + h AS pos, CAST(round_even(least(1.0, greatest(-1.0, CAST(v AS DOUBLE))) * 32767, 0) AS BIGINT) AS pcm FROM x, range({HELD}) AS r(h))
SELECT vec_id, pos // 100 AS block, pos // 100 * 100 AS begin, count(*) AS n, CAST(sum(pcm) AS BIGINT) AS total FROM s GROUP BY ALL""",
}
