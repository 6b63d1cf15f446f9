"""Registered vector, fusion and frame queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import frames as fr
from quillon.operators import fusion as fu
from quillon.operators import vectors as ve
from quillon.plans.domain import SAMPLES_SQL, TURNS_SQL, samples, turns, vectors

HOP = 8


def vec_centroid(spark, d):
    cents = ve.centroid(vectors(spark, d), ["label"])
    return cents.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", "pos", F.round("x", 6).alias("x"))


def vec_cosine_cross(spark, d):
    cents = ve.centroid(vectors(spark, d), ["label"]).withColumnRenamed("label", "proto")
    return ve.similarities(vectors(spark, d), cents).select("vec_id", "proto", F.round("similarity", 6).alias("similarity"))


def vec_identify(spark, d):
    cents = ve.centroid(vectors(spark, d), ["label"]).select(F.col("label").alias("proto"), "centroid")
    return ve.nearest(vectors(spark, d), cents, "proto").select("vec_id", "label", "proto", F.round("similarity", 6).alias("similarity"))


def vec_prefix20(spark, d):
    return ve.talk_time_prefix(turns(spark, d), ["rec", "spk"]).select("rec", "spk", "turn_id", "s_us", "e_us", "before_us")


def _scores(spark, d):
    """Three scores of each vector against its label's first vector, over three groups of dimensions."""
    rows = vectors(spark, d)
    first = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("p"))
    part = lambda c, a, n: F.slice(c, a, n)
    both = rows.join(first, "label")
    score = lambda a, n: ve.cosine(part("v", a, n), part("p", a, n))
    return both.select(
        "vec_id",
        "label",
        F.when(F.col("vec_id") % 7 != 0, score(1, 32)).alias("a"),
        F.when(F.col("vec_id") % 5 != 0, score(33, 16)).alias("b"),
        score(49, 16).alias("c"),
        fu.activity_factor((F.col("vec_id") % 9).cast("double")).alias("factor"),
    )


def fuse_weighted(spark, d):
    s = _scores(spark, d)
    return s.select("vec_id", F.round(fu.weighted([F.col("a"), F.col("b"), F.col("c")], F.col("factor")), 6).alias("score"))


def fuse_positive_mean(spark, d):
    s = _scores(spark, d)
    return s.select("vec_id", F.round(fu.positive_mean([F.col("a"), F.col("b"), F.col("c")], F.col("factor")), 6).alias("score"))


def fuse_accept_split(spark, d):
    return fu.split_accepted(fuse_weighted(spark, d), "score", 0.2)


def fuse_counts(spark, d):
    return fu.acceptance_counts(fuse_accept_split(spark, d))


def fuse_clean_split(spark, d):
    return fu.split_clean(_scores(spark, d).select("vec_id", F.round("a", 6).alias("clean_score")), "clean_score", 0.1)


def fuse_recombined(spark, d):
    """Clean clips as they are, and the others after cleaning lifted their score; those that stay unclean are dropped."""
    split = fuse_clean_split(spark, d)
    cleaned = split.filter("not clean").select("vec_id", F.round(F.coalesce("clean_score", F.lit(0.0)) + 0.2, 6).alias("clean_score")).filter("clean_score >= 0.1")
    return fu.recombined(split, cleaned)


def _levels(spark, d):
    return fr.frame_levels(samples(spark, d), "vec_id", HOP)


def frm_rms_db(spark, d):
    return _levels(spark, d).select("vec_id", "frame", F.round("rms_db", 6).alias("rms_db"))


def frm_overall_db(spark, d):
    return fr.overall_level(samples(spark, d), "vec_id").select("vec_id", F.round("level_db", 6).alias("level_db"))


def frm_peak_clip(spark, d):
    return fr.peaks(samples(spark, d), "vec_id").select("vec_id", F.round("peak_db", 6).alias("peak_db"), "clipping")


def frm_envelope(spark, d):
    return fr.envelope(samples(spark, d), "vec_id", 16, 4)


def _spans(spark, d):
    """Two speech spans of a vector's eight frames, from its id."""
    rows = vectors(spark, d)
    lengths = rows.select("vec_id", F.lit(8).alias("n"))
    at = F.array(F.struct((F.col("vec_id") % 3).cast("int").alias("first"), (F.col("vec_id") % 3 + 2).cast("int").alias("past")), F.struct((F.col("vec_id") % 5 + 3).cast("int").alias("first"), (F.col("vec_id") % 5 + 5).cast("int").alias("past")))
    return rows.select("vec_id", F.explode(at).alias("s")).select("vec_id", "s.*"), lengths


def frm_speech_mask(spark, d):
    return fr.speech_mask(*_spans(spark, d), "vec_id")


def _masked(spark, d):
    return frm_speech_mask(spark, d).join(frm_rms_db(spark, d), ["vec_id", "frame"])


def frm_zones(spark, d):
    return fr.zones(_masked(spark, d), "vec_id", 2)


def frm_silence_runs(spark, d):
    return fr.silence_runs(_masked(spark, d), "vec_id", -17.0, 2)


def frm_quietest(spark, d):
    return fr.quietest(frm_rms_db(spark, d), "vec_id")


def frm_run_levels(spark, d):
    """Levels of each label: the loudest frame, the middle and the share of quiet frames."""
    rows = frm_rms_db(spark, d).join(vectors(spark, d).select("vec_id", "label"), "vec_id")
    return rows.groupBy("label").agg(F.max("rms_db").alias("loudest_db"), F.round(F.percentile("rms_db", 0.5), 6).alias("middle_db"), F.count_if(F.col("rms_db") <= -20).alias("n_quiet"))


QUERIES = {f.__name__: f for f in (vec_centroid, vec_cosine_cross, vec_identify, vec_prefix20, fuse_weighted, fuse_positive_mean, fuse_accept_split, fuse_counts, fuse_clean_split, fuse_recombined, frm_rms_db, frm_overall_db, frm_peak_clip, frm_envelope, frm_speech_mask, frm_zones, frm_silence_runs, frm_quietest, frm_run_levels)}

_UNITS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, generate_subscripts(v, 1) - 1 AS pos, unnest(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))) AS x FROM v),
means AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM u GROUP BY label, pos),
cents AS (SELECT label, max(n) AS n, list(x ORDER BY pos) AS centroid FROM means GROUP BY label)"""
_SIMS = f"""{_UNITS},
sims AS (SELECT vec_id, v.label, c.label AS proto, list_inner_product(v, centroid) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(centroid, centroid))) AS similarity FROM v, cents c)"""


def _cos(a: int, b: int) -> str:
    return f"list_inner_product(v[{a}:{b}], p[{a}:{b}]) / (sqrt(list_inner_product(v[{a}:{b}], v[{a}:{b}])) * sqrt(list_inner_product(p[{a}:{b}], p[{a}:{b}])))"


_SCORED = f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT label, arg_min(v, vec_id) AS p FROM v GROUP BY label),
scores AS (SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN {_cos(1, 32)} END AS a, CASE WHEN vec_id % 5 <> 0 THEN {_cos(33, 48)} END AS b, {_cos(49, 64)} AS c,
  CASE WHEN vec_id % 9 >= 0.6 THEN 1.0 ELSE 0.1 END AS factor FROM v JOIN p USING (label)),
fused AS (SELECT vec_id, round((coalesce(a * 0.4, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.3, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + 0.3) * factor, 6) AS score FROM scores)"""
_LEVELS = f"""{SAMPLES_SQL},
levels AS (SELECT vec_id, pos // 8 AS frame, round(20 * log10(sqrt(sum(x * x) / 8 + 1e-10) + 1e-10), 6) AS rms_db FROM samples GROUP BY vec_id, pos // 8)"""
_MASK = """spans AS (SELECT vec_id, vec_id % 3 AS first, vec_id % 3 + 2 AS past FROM embeddings UNION ALL SELECT vec_id, vec_id % 5 + 3, vec_id % 5 + 5 FROM embeddings),
mask AS (SELECT vec_id, frame, EXISTS (SELECT 1 FROM spans s WHERE s.vec_id = e.vec_id AND s.first <= frame AND frame < s.past) AS speech FROM embeddings e, range(8) AS f(frame))"""


def _runs(quiet: str) -> str:
    return f"""{_LEVELS}, {_MASK},
flags AS (SELECT vec_id, frame, rms_db, {quiet} AS quiet FROM mask JOIN levels USING (vec_id, frame)),
runs AS (SELECT vec_id, min(frame) AS first, max(frame) AS last, arg_min(frame, (rms_db, frame)) AS quietest, min(rms_db) AS quietest_db FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS g FROM flags WHERE quiet) GROUP BY vec_id, g)"""


ORACLE_SQL = {
    "vec_centroid": f"WITH {_UNITS} SELECT label, n, pos, round(x, 6) AS x FROM means",
    "vec_cosine_cross": f"WITH {_SIMS} SELECT vec_id, proto, round(similarity, 6) AS similarity FROM sims",
    "vec_identify": f"WITH {_SIMS} SELECT vec_id, label, arg_max(proto, (similarity, -proto)) AS proto, round(max(similarity), 6) AS similarity FROM sims GROUP BY vec_id, label",
    "vec_prefix20": f"WITH {TURNS_SQL}, b AS (SELECT rec, spk, turn_id, s_us, e_us, CAST(coalesce(sum(e_us - s_us) OVER (PARTITION BY rec, spk ORDER BY s_us, e_us, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_us FROM turns) SELECT * FROM b WHERE before_us < 20000000",
    "fuse_weighted": f"WITH {_SCORED} SELECT * FROM fused",
    "fuse_positive_mean": f"WITH {_SCORED}, k AS (SELECT vec_id, factor, list_filter([a, b, c], lambda x: x > 0) AS kept FROM scores) SELECT vec_id, round(CASE WHEN len(kept) > 0 THEN list_sum(kept) / len(kept) * factor ELSE 0 END, 6) AS score FROM k",
    "fuse_accept_split": f"WITH {_SCORED} SELECT vec_id, score, score >= 0.2 AS accepted FROM fused",
    "fuse_counts": f"WITH {_SCORED} SELECT count(*) FILTER (WHERE score >= 0.2) AS n_accepted, count(*) FILTER (WHERE score < 0.2) AS n_rejected FROM fused",
    "fuse_clean_split": f"WITH {_SCORED} SELECT vec_id, round(a, 6) AS clean_score, coalesce(round(a, 6), 0) >= 0.1 AS clean FROM scores",
    "fuse_recombined": f"WITH {_SCORED}, c AS (SELECT vec_id, coalesce(round(a, 6), 0) AS s FROM scores) SELECT vec_id, s AS clean_score, 'as_is' AS origin FROM c WHERE s >= 0.1 UNION ALL SELECT vec_id, round(s + 0.2, 6), 'cleaned' FROM c WHERE s < 0.1 AND round(s + 0.2, 6) >= 0.1",
    "frm_rms_db": f"WITH {_LEVELS} SELECT * FROM levels",
    "frm_overall_db": f"WITH {SAMPLES_SQL} SELECT vec_id, round(CASE WHEN sqrt(avg(x * x)) > 1e-9 THEN 20 * log10(sqrt(avg(x * x))) ELSE -120 END, 6) AS level_db FROM samples GROUP BY vec_id",
    "frm_peak_clip": f"WITH {SAMPLES_SQL} SELECT vec_id, round(20 * log10(max(abs(x)) + 1e-10), 6) AS peak_db, max(abs(x)) >= 0.999969 AS clipping FROM samples GROUP BY vec_id",
    "frm_envelope": f"WITH {SAMPLES_SQL} SELECT vec_id, pos // 16 AS col, max(abs(x)) AS peak FROM samples WHERE pos % 16 % 4 = 0 GROUP BY vec_id, pos // 16",
    "frm_speech_mask": f"WITH {_MASK} SELECT * FROM mask",
    "frm_zones": f"WITH {_runs('NOT speech')} SELECT *, last - first + 1 >= 2 AS long_enough FROM runs",
    "frm_silence_runs": f"WITH {_runs('NOT speech AND rms_db <= -17')} SELECT * FROM runs WHERE last - first + 1 >= 2",
    "frm_quietest": f"WITH {_LEVELS} SELECT vec_id, arg_min(frame, (rms_db, frame)) AS frame, min(rms_db) AS rms_db FROM levels GROUP BY vec_id",
    "frm_run_levels": f"WITH {_LEVELS} SELECT label, max(rms_db) AS loudest_db, round(quantile_cont(rms_db, 0.5), 6) AS middle_db, count(*) FILTER (WHERE rms_db <= -20) AS n_quiet FROM levels JOIN embeddings USING (vec_id) GROUP BY label",
}
