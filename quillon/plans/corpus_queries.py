"""Registered queries: mining, comparison, incremental runs, catalog, segmenter, sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import catalog as ca
from quillon.operators import compare as co
from quillon.operators import fusion as fu
from quillon.operators import intervals as iv
from quillon.operators import manifest as mf
from quillon.operators import mining as mi
from quillon.operators import segmenter as sg
from quillon.plans.domain import DAY_US, TURNS_SQL, table, turns
from quillon.plans.interval_queries import islands
from quillon.plans.vector_queries import _masked, fuse_weighted
from quillon.plans.text_queries import ORACLE_SQL as TEXT_SQL
from quillon.plans.text_queries import _dataset, ds_eval, ds_train
from quillon.plans.vector_queries import _LEVELS, _MASK
from quillon.plans.vector_queries import ORACLE_SQL as VECTOR_SQL

MOST_US, LEAST_US, GAP_US = 60_000_000, 10_000_000, 5_000_000


def _speech(spark, d):
    return turns(spark, d).select("rec", "s_us", "e_us")


def mine_windows(spark, d):
    return mi.windows(_speech(spark, d), ["rec"], GAP_US, MOST_US, LEAST_US)


def mine_scored(spark, d):
    found = mi.scored(mine_windows(spark, d), _speech(spark, d), ["rec"], 0.9)
    return found.select("rec", "s_us", "e_us", "voiced_us", "density", "score")


def mine_longest_first(spark, d):
    return mi.longest_first(iv.complement(_speech(spark, d), ["rec"], DAY_US), ["rec"], 20)


def mine_diverse(spark, d):
    return mi.diverse(mine_scored(spark, d), ["rec"], 5, mi.spread_us(DAY_US, 5))


def _run(spark, d, drop):
    """Two runs of one extraction: the second loses some clips and shifts some scores."""
    rows = fuse_weighted(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return rows.filter(F.col("vec_id") % drop != 0) if drop else rows


def cmp_jaccard(spark, d):
    a, b = (fu.split_accepted(_run(spark, d, x), "score", 0.2).filter("accepted") for x in (13, 17))
    return co.jaccard(a, b, ["label"], "vec_id").select("label", "n_both", "n_any", F.round("jaccard", 6).alias("jaccard"))


def cmp_score_delta(spark, d):
    a = _run(spark, d, 0)
    b = a.withColumn("score", F.col("score") + F.when(F.col("vec_id") % 3 == 0, 0.01).otherwise(0.0)).filter((F.col("label") != 4) | (F.col("vec_id") % 13 != 0))
    return co.score_delta(a, b, ["label"], "vec_id", "score").select("label", F.round("delta", 6).alias("delta"))


def _transcripts(spark, d):
    heard = F.regexp_replace(F.replace("text", F.lit(" the "), F.lit(" ")), r"\bof\b", "off")
    return table(spark, d, "conversations").select("conv_id", "turn", "text", heard.alias("heard"))


def cmp_wer(spark, d):
    return co.word_errors(_transcripts(spark, d), "text", "heard").select("conv_id", "turn", F.round("wer", 6).alias("wer"))


def cmp_verdict(spark, d):
    errors = co.word_errors(_transcripts(spark, d), "text", "heard").select((F.col("conv_id") % 10).cast("int").alias("label"), "wer")
    return co.verdict(cmp_jaccard(spark, d), cmp_score_delta(spark, d), errors, ["label"]).select("label", "jaccard", "delta", F.round("wer", 6).alias("wer"), "identical")


def cmp_split_disjoint(spark, d):
    """How many clips stand in both parts of the split, or in neither: zeros."""
    train, held = ds_train(spark, d).select("clip_id"), ds_eval(spark, d).select("clip_id")
    every = _dataset(spark, d).select("clip_id")
    return train.intersect(held).agg(F.count("*").alias("n_both")).crossJoin(every.exceptAll(train.union(held)).agg(F.count("*").alias("n_neither")))


def _jobs(spark, d):
    key = tx.job_key(F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string")), F.array("source", "lang"), F.concat(F.lit(" "), F.upper("lang")))
    return table(spark, d, "documents").select("doc_id", "source", key.alias("job_key"))


def mft_key(spark, d):
    return _jobs(spark, d)


def _manifest(spark, d):
    status = F.when(F.col("doc_id") % 4 == 0, "in_progress").otherwise("done")
    return _jobs(spark, d).filter("doc_id % 3 = 0").select("job_key", status.alias("status"))


def mft_pending(spark, d):
    return mf.pending(_jobs(spark, d), _manifest(spark, d))


def mft_poison_skip(spark, d):
    return mf.after_crash(_jobs(spark, d), _manifest(spark, d), ["source"], "doc_id")


def mft_upsert(spark, d):
    updates = _jobs(spark, d).filter("doc_id % 6 = 0").select("job_key", F.lit("failed").alias("status"))
    return mf.upsert(_manifest(spark, d), updates)


def log_last_wins(spark, d):
    log = table(spark, d, "events").select(F.col("user_id"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("text"), "event_id")
    return mf.last_wins(log, "user_id", "text", "event_id")


def cat_runs(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count_if(F.trim("text") != "").alias("n_clips"), F.count_distinct("lang").alias("n_langs"), F.bool_or(F.col("n_chars") > 10_000).alias("has_long"), F.max("doc_id").alias("newest"))


def cat_newest(spark, d):
    return ca.newest(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey")


def cat_search(spark, d):
    return table(spark, d, "documents").filter(ca.matches("  THE an", "source", "text")).select("doc_id")


def cat_page(spark, d):
    return ca.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), "doc_id"], 2, 20)


def cat_speaker_from_dir(spark, d):
    path = F.concat(F.lit("/out/"), "source", F.lit("_run_"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", ca.speaker_of(path).alias("speaker"))


def _events(spark, d):
    return turns(spark, d).select("rec", F.col("turn_id").alias("event_id"), F.col("spk").alias("stage"), F.col("s_us").alias("starts"))


def cat_stage_times(spark, d):
    return ca.stage_times(_events(spark, d), "rec", "starts").select("rec", "event_id", "stage", "starts", "ends")


def cat_event_rate(spark, d):
    return ca.trailing_rate(_events(spark, d), "rec", "starts", 90_000_000).select("rec", "event_id", "rate")


def cat_last_lines(spark, d):
    return ca.last_lines(_events(spark, d), "rec", [F.col("starts").desc(), F.col("event_id").desc()], 40).select("rec", "event_id")


def cat_prereq_closure(spark, d):
    """Prerequisites of parts: each part needs the one of half its key."""
    edges = table(spark, d, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).alias("needs"))
    return ca.closure(edges)


#: Lengths of the segmenter query, in frames of a few seconds' worth of data.
SHORT = sg.Limits(min_silence=0.02, pad=0.01, snap=0.02, least=0.1, most=0.3, hard=0.4)


#: Ids of vectors in one region.
REGION_IDS = 512


def _track(spark, d):
    """Vectors of a label, one after another, as regions of frames: each holds at most the vectors of a block of ids."""
    region = F.concat(F.col("label").cast("string"), F.lit("/"), F.floor(F.col("vec_id") / REGION_IDS).cast("string"))
    labels = table(spark, d, "embeddings").select("vec_id", region.alias("region"))
    place = labels.withColumn("nth", F.row_number().over(Window.partitionBy("region").orderBy("vec_id")) - 1)
    return _masked(spark, d).join(place, "vec_id").select("region", (F.col("nth") * 8 + F.col("frame")).cast("int").alias("frame"), "rms_db", "speech")


def seg_walk(spark, d):
    from quillon.operators import frames as fr

    track = _track(spark, d)
    rows = sg.region_rows(track, fr.zones(track, "region", SHORT.frames()[0]), "region")
    label, block = (F.split_part("region", F.lit("/"), F.lit(i)) for i in (1, 2))
    flags = {"vad": F.lit(True), "start_safe": label.cast("long") % 2 == 0, "end_safe": F.lit(True)}
    clips = sg.segment(rows.withColumns(flags), "region", SHORT)
    kind = table(spark, d, "embeddings").schema["label"].dataType
    return clips.select(label.cast(kind).alias("label"), block.cast("long").alias("block"), *clips.columns[1:])


def seg_validated_only(spark, d):
    return seg_walk(spark, d).filter("validated").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("past") - F.col("first")).alias("frames"))


def src_silences(spark, d):
    # seconds are rounded to thousandths as doubles, as the SQL does; decimals would part from it where half a thousandth is no double
    seconds = lambda us: (F.floor(F.col(us) / 1000000 * 1000 + 0.5) / 1000).cast("decimal(18,3)").cast("string")
    log = turns(spark, d).select("turn_id", F.concat(F.lit("silence_start: "), seconds("s_us"), F.lit("\nsilence_end: "), seconds("e_us"), F.lit(" | x\nsilence_start: 99.5")).alias("text"))
    return mi.silence_rows(log, "turn_id", "text")


QUERIES = {f.__name__: f for f in (mine_windows, mine_scored, mine_longest_first, mine_diverse, cmp_jaccard, cmp_score_delta, cmp_wer, cmp_verdict, cmp_split_disjoint, mft_key, mft_pending, mft_poison_skip, mft_upsert, log_last_wins, cat_runs, cat_newest, cat_search, cat_page, cat_speaker_from_dir, cat_stage_times, cat_event_rate, cat_last_lines, cat_prereq_closure, seg_walk, seg_validated_only, src_silences)}

_WINDOWS = f"""{TURNS_SQL},
{islands("turns", "regions", "rec", GAP_US)},
windows AS (SELECT rec, e_us - s_us AS region_us, unnest(range(s_us, e_us - {LEAST_US} + 1, {MOST_US})) AS s_us, e_us AS stop FROM regions WHERE e_us - s_us >= {LEAST_US}),
tiles AS (SELECT rec, region_us, s_us, least(s_us + {MOST_US}, stop) AS e_us FROM windows)"""
_SCORED = f"""{_WINDOWS},
voiced AS (SELECT w.rec, w.s_us, w.e_us, region_us, CAST(coalesce(sum(least(t.e_us, w.e_us) - greatest(t.s_us, w.s_us)) FILTER (WHERE t.s_us IS NOT NULL), 0) AS BIGINT) AS voiced_us
  FROM tiles w LEFT JOIN turns t ON w.rec = t.rec AND t.s_us < w.e_us AND w.s_us < t.e_us GROUP BY ALL)"""
_FUSED = VECTOR_SQL["fuse_weighted"].removeprefix("WITH ").removesuffix(" SELECT * FROM fused") + ", run AS (SELECT f.vec_id, score, label FROM fused f JOIN embeddings USING (vec_id))"
_JACCARD = f"""{_FUSED}, met AS (SELECT label, vec_id % 13 <> 0 AS a, vec_id % 17 <> 0 AS b FROM run WHERE score >= 0.2),
jac AS (SELECT label, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a OR b) AS n_any FROM met WHERE a OR b GROUP BY label)"""
_JOBS = """jobs AS (SELECT doc_id, source, left(sha1('/in/' || lower(source) || '/' || doc_id || chr(0) || array_to_string(list_sort([lower(source), lower(lang)]), '|') || chr(0) || lower(lang)), 16) AS job_key FROM documents),
manifest AS (SELECT job_key, CASE WHEN doc_id % 4 = 0 THEN 'in_progress' ELSE 'done' END AS status FROM jobs WHERE doc_id % 3 = 0)"""

#: Edit distance of word lists, a row of the table a step; a row's left neighbour comes in as the least of what lies before, counted up.
_WER = r"""pairs AS (SELECT row_number() OVER () AS id, conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS r,
  list_filter(regexp_split_to_array(coalesce(regexp_replace(replace(text, ' the ', ' '), '\bof\b', 'off', 'g'), ''), '\s+'), lambda w: w <> '') AS h FROM conversations),
steps(id, i, line) AS (SELECT id, CAST(0 AS BIGINT), range(0, len(h) + 1) FROM pairs UNION ALL
  SELECT id, i + 1, list_transform(range(0, len(t)), lambda j: j + list_min(t[1 : j + 1])) FROM (
    SELECT s.id, i, list_transform(range(0, len(h) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(line[j + 1] + 1, line[j] + CASE WHEN r[i + 1] = h[j] THEN 0 ELSE 1 END) END - j) AS t
    FROM steps s JOIN pairs p ON s.id = p.id WHERE i < len(r))),
wers AS (SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE line[-1] / len(r) END AS wer FROM steps s JOIN pairs p ON s.id = p.id AND i = len(r))"""
_APART_US = mi.spread_us(DAY_US, 5)
#: The walk as a fold: a state for each region holds the cursor; a step emits one clip, or lengthens the last.
_MIN_SILENCE, _PAD, _SNAP, _LEAST, _MOST, _HARD = SHORT.frames()
_WALK = f"""{_LEVELS}, {_MASK},
placed AS (SELECT vec_id, label, vec_id // {REGION_IDS} AS block, row_number() OVER (PARTITION BY label, vec_id // {REGION_IDS} ORDER BY vec_id) - 1 AS nth FROM embeddings),
track AS (SELECT label, block, nth * 8 + frame AS frame, rms_db, speech FROM placed JOIN mask USING (vec_id) JOIN levels USING (vec_id, frame)),
zone AS (SELECT label, block, min(frame) AS first, max(frame) AS last, arg_min(frame, (rms_db, frame)) AS q FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY label, block ORDER BY frame) AS g FROM track WHERE NOT speech) GROUP BY label, block, g),
zones AS (SELECT label, block, list({{'q': q, 'last': last, 'long': last - first + 1 >= {_MIN_SILENCE}}} ORDER BY first) AS zones FROM zone GROUP BY label, block),
tracks AS (SELECT label, block, list(rms_db ORDER BY frame) AS levels, list(speech ORDER BY frame) AS speech, count(*) AS n FROM track GROUP BY label, block),
region AS (SELECT t.*, coalesce(zones, []) AS zones, list_min(list_filter(range(1, n), lambda f: speech[f] AND NOT speech[f + 1])) AS fall FROM tracks t LEFT JOIN zones z ON t.label = z.label AND t.block = z.block),
edged AS (SELECT *, CASE WHEN label % 2 = 0 OR NOT speech[1] THEN 0 ELSE coalesce(list_min(list_transform(list_filter(zones, lambda z: z.q <= {_SNAP}), lambda z: z.q)), CASE WHEN fall < n - 1 THEN fall END, 0) END AS start FROM region),
walk(label, block, cursor, clip, first, past, validated, longer, done) AS (
  SELECT label, block, CAST(start AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), false, false FROM edged
  UNION ALL
  SELECT label, block, CAST(CASE WHEN NOT ends AND zone IS NOT NULL AND zone.q > cursor THEN zone.q ELSE cut END AS BIGINT), CASE WHEN ends AND left_ < {_LEAST} AND clip > 0 THEN clip ELSE clip + 1 END,
    CAST(cursor AS BIGINT), CAST(cut AS BIGINT), CASE WHEN ends OR zone IS NOT NULL THEN good ELSE good AND cut < n AND NOT speech[cut + 1] END, ends AND left_ < {_LEAST} AND clip > 0, ends
  FROM (
    SELECT *, CASE WHEN ends THEN n WHEN zone IS NOT NULL THEN greatest(least(zone.last + 1, zone.q + {_PAD}, n), cursor + 1)
      WHEN quietest > cursor THEN quietest ELSE least(cursor + {_MOST}, n) END AS cut
    FROM (
      SELECT w.label, w.block, w.cursor, w.clip, e.n, e.speech, n - cursor AS left_, n - cursor <= {_HARD} AS ends,
        CASE WHEN cursor = start THEN (start = 0 AND w.label % 2 = 0) OR NOT speech[start + 1] ELSE NOT speech[cursor + 1] END AS good,
        list_sort(list_transform(list_filter(zones, lambda z: z.q >= cursor + {_LEAST} AND z.q <= least(cursor + {_HARD}, n)), lambda z: {{'p': CASE WHEN z.q <= cursor + {_MOST} THEN CASE WHEN z.long THEN 0 ELSE 1 END WHEN z.long THEN 2 ELSE 3 END,
          'd': CASE WHEN z.q <= cursor + {_MOST} THEN z.q ELSE z.q - (cursor + {_MOST}) END, 'q': z.q, 'last': z.last}}))[1] AS zone,
        least(cursor + {_MOST}, n - 1) + list_position(levels[least(cursor + {_MOST}, n - 1) + 1 : least(cursor + {_HARD}, n)], list_min(levels[least(cursor + {_MOST}, n - 1) + 1 : least(cursor + {_HARD}, n)])) - 1 AS quietest
      FROM walk w JOIN edged e ON w.label = e.label AND w.block = e.block WHERE NOT done AND cursor < n))),
clips AS (SELECT label, block, clip - 1 AS clip, min(first) FILTER (WHERE NOT longer) AS first, max(past) AS past, bool_or(validated) FILTER (WHERE NOT longer) AS validated FROM walk WHERE first IS NOT NULL GROUP BY label, block, clip),
walked AS (SELECT c.label, c.block, CAST(clip AS INT) AS clip, CAST(first AS INT) AS first, CAST(past AS INT) AS past, validated, levels[least(first, n - 1) + 1] AS first_db, levels[least(past, n - 1) + 1] AS past_db FROM clips c JOIN edged e ON c.label = e.label AND c.block = e.block)"""

ORACLE_SQL = {
    "cmp_wer": f"WITH RECURSIVE {_WER} SELECT conv_id, turn, round(wer, 6) AS wer FROM wers",
    "cmp_verdict": f"""WITH RECURSIVE {_WER}, {_JACCARD},
j AS (SELECT label, round(n_both / n_any, 6) AS jaccard FROM jac),
d AS (SELECT label, round(max(CASE WHEN label = 4 AND vec_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE abs(score - (score + CASE WHEN vec_id % 3 = 0 THEN 0.01 ELSE 0 END)) END), 6) AS delta FROM run GROUP BY label),
e AS (SELECT CAST(conv_id % 10 AS INT) AS label, max(wer) AS wer FROM wers GROUP BY conv_id % 10),
m AS (SELECT label, coalesce(jaccard, 1.0) AS jaccard, coalesce(delta, 0.0) AS delta, coalesce(wer, 0.0) AS wer FROM j FULL JOIN d USING (label) FULL JOIN e USING (label))
SELECT label, jaccard, delta, round(wer, 6) AS wer, jaccard = 1 AND delta = 0 AND wer = 0 AS identical FROM m""",
    "seg_walk": f"WITH RECURSIVE {_WALK} SELECT * FROM walked",
    "seg_validated_only": f"WITH RECURSIVE {_WALK} SELECT label, count(*) AS n, CAST(sum(past - first) AS BIGINT) AS frames FROM walked WHERE validated GROUP BY label",
    "mine_diverse": f"""WITH RECURSIVE {_SCORED}, s AS (SELECT rec, s_us, e_us, least(region_us / 1000000, 60) + (voiced_us / (e_us - s_us)) * 25 AS score FROM voiced WHERE voiced_us / (e_us - s_us) >= 0.9),
w AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY score DESC, s_us, e_us) AS nth FROM s),
fold(rec, nth, picks) AS (SELECT rec, nth, [{{'n': nth, 'c': s_us + e_us}}] FROM w WHERE nth = 1 UNION ALL
  SELECT w.rec, w.nth, CASE WHEN len(picks) < 5 AND len(list_filter(picks, lambda p: abs(p.c - (s_us + e_us)) < {2 * _APART_US})) = 0 THEN list_append(picks, {{'n': w.nth, 'c': s_us + e_us}}) ELSE picks END FROM fold f JOIN w ON w.rec = f.rec AND w.nth = f.nth + 1),
chosen AS (SELECT rec, arg_max(list_transform(picks, lambda p: p.n), nth) AS picks FROM fold GROUP BY rec),
ordered AS (SELECT w.rec, s_us, e_us, score, row_number() OVER (PARTITION BY w.rec ORDER BY NOT list_contains(picks, nth), nth) - 1 AS pick FROM w JOIN chosen c ON w.rec = c.rec)
SELECT rec, CAST(pick AS INT) AS pick, s_us, e_us, score FROM ordered WHERE pick < 5""",
    "mine_windows": f"WITH {_WINDOWS} SELECT rec, region_us, s_us, e_us FROM tiles",
    "mine_scored": f"WITH {_SCORED} SELECT rec, s_us, e_us, voiced_us, voiced_us / (e_us - s_us) AS density, least(region_us / 1000000, 60) + (voiced_us / (e_us - s_us)) * 25 AS score FROM voiced WHERE voiced_us / (e_us - s_us) >= 0.9",
    "mine_longest_first": f"""WITH {TURNS_SQL}, cut AS (SELECT rec, s_us, least(e_us, {DAY_US}) AS e_us FROM turns WHERE least(e_us, {DAY_US}) > s_us), {islands("cut", "held", "rec")},
free AS (SELECT rec, coalesce(lag(e_us) OVER (PARTITION BY rec ORDER BY s_us), 0) AS s_us, s_us AS e_us FROM held UNION ALL SELECT rec, max(e_us), {DAY_US} FROM held GROUP BY rec),
ranked AS (SELECT rec, s_us, e_us, row_number() OVER (PARTITION BY rec ORDER BY e_us - s_us DESC, s_us) AS place FROM free WHERE e_us > s_us) SELECT * FROM ranked WHERE place <= 20""",
    "cmp_jaccard": f"WITH {_JACCARD} SELECT label, n_both, n_any, round(n_both / n_any, 6) AS jaccard FROM jac",
    "cmp_score_delta": f"WITH {_FUSED} SELECT label, round(max(CASE WHEN label = 4 AND vec_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE abs(score - (score + CASE WHEN vec_id % 3 = 0 THEN 0.01 ELSE 0 END)) END), 6) AS delta FROM run GROUP BY label",
    "cmp_split_disjoint": f"""SELECT (SELECT count(*) FROM (SELECT clip_id FROM ({TEXT_SQL['ds_train']}) INTERSECT SELECT clip_id FROM ({TEXT_SQL['ds_eval']}))) AS n_both,
  (SELECT count(*) FROM (SELECT clip_id FROM ({TEXT_SQL['dataset_metadata']}) EXCEPT ALL (SELECT clip_id FROM ({TEXT_SQL['ds_train']}) UNION ALL SELECT clip_id FROM ({TEXT_SQL['ds_eval']})))) AS n_neither""",
    "mft_key": f"WITH {_JOBS} SELECT * FROM jobs",
    "mft_pending": f"WITH {_JOBS} SELECT * FROM jobs WHERE job_key NOT IN (SELECT job_key FROM manifest WHERE status = 'done')",
    "mft_poison_skip": f"WITH {_JOBS}, left_over AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM jobs WHERE job_key NOT IN (SELECT job_key FROM manifest WHERE status = 'done')) SELECT doc_id, source, job_key FROM left_over WHERE nth > 1",
    "mft_upsert": f"WITH {_JOBS} SELECT job_key, status FROM manifest WHERE job_key NOT IN (SELECT job_key FROM jobs WHERE doc_id % 6 = 0) UNION ALL SELECT job_key, 'failed' FROM jobs WHERE doc_id % 6 = 0",
    "log_last_wins": "SELECT user_id, arg_max(coalesce(CASE WHEN event_id % 9 <> 0 THEN event_type END, ''), event_id) AS text FROM events GROUP BY user_id",
    "cat_runs": "SELECT source, count(*) FILTER (WHERE trim(text) <> '') AS n_clips, count(DISTINCT lang) AS n_langs, bool_or(n_chars > 10000) AS has_long, max(doc_id) AS newest FROM documents GROUP BY source",
    "cat_newest": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
    "cat_search": "SELECT doc_id FROM documents WHERE contains(lower(source), 'the an') OR contains(lower(text), 'the an')",
    "cat_page": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40",
    "cat_speaker_from_dir": "SELECT doc_id, split_part(source || '_run_' || doc_id, '_', 1) AS speaker FROM documents",
    "cat_stage_times": f"WITH {TURNS_SQL} SELECT rec, turn_id AS event_id, spk AS stage, s_us AS starts, lead(s_us) OVER (PARTITION BY rec ORDER BY s_us, turn_id) AS ends FROM turns",
    "cat_event_rate": f"WITH {TURNS_SQL} SELECT rec, turn_id AS event_id, count(*) OVER (PARTITION BY rec ORDER BY s_us RANGE BETWEEN 90000000 PRECEDING AND CURRENT ROW) AS rate FROM turns",
    "cat_last_lines": f"WITH {TURNS_SQL}, r AS (SELECT rec, turn_id AS event_id, row_number() OVER (PARTITION BY rec ORDER BY s_us DESC, turn_id DESC) AS nth FROM turns) SELECT rec, event_id FROM r WHERE nth <= 40",
    "cat_prereq_closure": "WITH RECURSIVE c(node, needs) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 1 UNION SELECT node, needs // 2 FROM c WHERE needs > 1) SELECT node, needs FROM c",
    "src_silences": f"WITH {TURNS_SQL} SELECT turn_id, CAST(round(s_us / 1000000, 3) * 1000000 AS BIGINT) AS s_us, CAST(round(e_us / 1000000, 3) * 1000000 AS BIGINT) AS e_us FROM turns UNION ALL SELECT turn_id, 99500000, NULL FROM turns",
}
