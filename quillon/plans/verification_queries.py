"""Registered queries of reference preparation and verification, and their SQL.

Vectors stand for recordings of 64 samples, labels for targets.  Three plain
models, each with a space of its own, stand for neural ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import fusion as fu
from quillon.operators import verification as vf
from quillon.plans.domain import table, vectors
from quillon.plans.shared import shared_path
from quillon.sources import references as rf
from quillon.sources import sound_files as sf

#: Every so many vectors one is a reference clip.
REFERENCES = 20
#: The model of lags fails on recordings that begin above this.
LOUD_START = 0.1
#: Samples above this count as speech.
QUIET = 0.05


def _raw(x: np.ndarray) -> np.ndarray:
    return x


def _bands(x: np.ndarray) -> np.ndarray:
    """Energy of eight stretches."""
    return (x**2).reshape(8, -1).sum(axis=1)


def _lags(x: np.ndarray) -> np.ndarray:
    """Autocorrelation at eight lags."""
    if x[0] > LOUD_START:
        raise ValueError("begins too loud")
    return np.array([x[: len(x) - lag] @ x[lag:] for lag in range(8)])


MODELS = {"raw": _raw, "lags": _lags, "bands": _bands}
SLOTS = (vf.Slot("rvector", "raw", 0.4), vf.Slot("ecapa", "lags", 0.3), vf.Slot("gemini", "bands", 0.3))


def _verified(spark, d, slots):
    """Clips that claim to be their label's, every third one the next label's, against the prototypes of references."""
    waves = vectors(spark, d).withColumnRenamed("v", "samples")
    is_reference = F.col("vec_id") % REFERENCES == 0
    claim = F.col("label") + F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)
    speech = F.size(F.filter("samples", lambda x: F.abs(x) > QUIET)) / F.size("samples")
    clips = waves.filter(~is_reference).select("vec_id", claim.alias("target"), speech.alias("ratio"), "samples")
    found = vf.prototypes(vf.embedded(waves.filter(is_reference).select(F.col("label").alias("target"), "samples"), MODELS), "target")
    rows = vf.scored(vf.embedded(clips, MODELS), found, "target", "vec_id", slots)
    return vf.verified(rows, fu.activity_factor(F.col("ratio")), slots)


def ver_scores(spark, d):
    """Every clip's scores in three spaces and the fused one."""
    rows = _verified(spark, d, SLOTS)
    parts = [F.round(F.try_element_at("scores", F.lit(s.name)), 6).alias(s.name) for s in SLOTS]
    return rows.select("vec_id", "target", *parts, F.try_element_at("failures", F.lit("lags")).alias("failure"), F.round("score", 6).alias("score"))


def ver_shared_space(spark, d):
    """The same with one model in two slots, which share its prototype."""
    rows = _verified(spark, d, vf.one_model("bands", SLOTS))
    return rows.select("vec_id", F.round("score", 6).alias("score"))


#: Samples a second of the stored reference files.
STORED_RATE = 8_000


def _stored(spark, d):
    """Reference files; every third one has no samples."""
    sf.install(spark)
    path = shared_path(spark, "references")
    sound = F.when(F.col("vec_id") % 3 != 0, F.col("embedding").cast("array<double>")).otherwise(F.array().cast("array<double>"))
    rows = table(spark, d, "embeddings").filter(F.col("vec_id") % 5 != 0).select(F.format_string("v%08d.wav", "vec_id").alias("name"), F.lit(STORED_RATE).alias("rate"), sound.alias("samples"))
    rows.write.format("quillon_sound").mode("append").save(path)
    return path


def src_references(spark, d):
    """References of every label: what is wrong with each, how many samples it has at the models' rate, and their sum in half 16-bit steps."""
    path = _stored(spark, d)
    wanted = table(spark, d, "embeddings").select(F.col("label").alias("target"), F.col("vec_id").alias("clip_no"), F.format_string("v%08d.wav", "vec_id").alias("name"))
    samples = rf.prepared(spark, wanted, path, strict=False)
    sums = samples.groupBy("target", "clip_no").agg(F.count("*").alias("n"), F.sum(F.bround(F.col("x") * 65536).cast("long")).alias("total"))
    return rf.checked(spark, wanted, path).join(sums, ["target", "clip_no"], "left").select("target", "clip_no", "error", F.coalesce("n", F.lit(0)).alias("n"), "total")


QUERIES = {f.__name__: f for f in (ver_scores, ver_shared_space, src_references)}

_VERIFIED = f"""waves AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
prints AS (SELECT vec_id, label, 'raw' AS model, v FROM waves UNION ALL
  SELECT vec_id, label, 'bands', list_transform(range(8), lambda b: list_sum(list_transform(v[b * 8 + 1 : b * 8 + 8], lambda x: x * x))) FROM waves UNION ALL
  SELECT vec_id, label, 'lags', list_transform(range(8), lambda l: list_sum(list_transform(range(64 - l), lambda i: v[i + 1] * v[i + l + 1]))) FROM waves WHERE v[1] <= {LOUD_START}::DOUBLE),
units AS (SELECT label, model, generate_subscripts(v, 1) AS pos, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS x FROM prints WHERE vec_id % {REFERENCES} = 0),
means AS (SELECT label, model, pos, avg(x) AS x FROM units GROUP BY ALL),
protos AS (SELECT label AS target, model, list(x ORDER BY pos) AS p FROM means GROUP BY ALL),
clips AS (SELECT vec_id, label + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS target, CASE WHEN len(list_filter(v, lambda x: abs(x) > {QUIET}::DOUBLE)) / len(v) >= 0.6 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS factor, v[1] > {LOUD_START}::DOUBLE AS failed FROM waves WHERE vec_id % {REFERENCES} <> 0),
sims AS (SELECT c.vec_id, c.model, list_cosine_similarity(c.v, p.p) AS s FROM prints c JOIN clips USING (vec_id) JOIN protos p ON p.target = clips.target AND p.model = c.model),
wide AS (SELECT c.vec_id, target, factor, failed, max(s) FILTER (WHERE model = 'raw') AS rvector, max(s) FILTER (WHERE model = 'lags') AS ecapa, max(s) FILTER (WHERE model = 'bands') AS gemini FROM clips c LEFT JOIN sims USING (vec_id) GROUP BY ALL)"""


def _fused(parts: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({c} * {w}::DOUBLE, 0)" for c, w in parts.items())
    bottom = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for c, w in parts.items())
    return f"round(CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) * factor ELSE 0 END, 6)"


ORACLE_SQL = {
    "ver_scores": f"WITH {_VERIFIED} SELECT vec_id, target, round(rvector, 6) AS rvector, round(ecapa, 6) AS ecapa, round(gemini, 6) AS gemini, CASE WHEN failed THEN 'begins too loud' END AS failure, {_fused({'rvector': 0.4, 'ecapa': 0.3, 'gemini': 0.3})} AS score FROM wide",
    "ver_shared_space": f"WITH {_VERIFIED} SELECT vec_id, {_fused({'gemini': 0.7, 'ecapa': 0.3})} AS score FROM wide",
    "src_references": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 3 <> 0),
pcm AS (SELECT vec_id, i, CAST(round_even(least(1.0, greatest(-1.0, CAST(v AS DOUBLE))) * 32767, 0) AS BIGINT) AS p FROM x),
steps AS (SELECT vec_id, 2 * p AS whole, p + coalesce(lead(p) OVER (PARTITION BY vec_id ORDER BY i), p) AS half FROM pcm),
sums AS (SELECT vec_id, 2 * count(*) AS n, CAST(sum(whole + half) AS BIGINT) AS total FROM steps GROUP BY vec_id)
SELECT label AS target, vec_id AS clip_no, CASE WHEN vec_id % 5 = 0 THEN 'missing' WHEN vec_id % 3 = 0 THEN 'empty' END AS error, coalesce(n, 0) AS n, total FROM embeddings LEFT JOIN sums USING (vec_id)""",
}
