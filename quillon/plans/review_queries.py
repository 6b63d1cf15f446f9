"""Registered queries: browsing of runs, rules with their truth tables, names, readers' rows, exports; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import rules as ru
from quillon.functions import text as tx
from quillon.operators import audio as au
from quillon.operators import catalog as ca
from quillon.operators import frames as fr
from quillon.operators import intervals as iv
from quillon.plans.audio_queries import ORACLE_SQL as AUDIO_SQL
from quillon.plans.domain import TURNS_SQL, samples, table, turns, vectors
from quillon.plans.interval_queries import islands
from quillon.sources import readers as rd
from quillon.sources import sinks as si

MOST_CLIPS = 3000
FLOOR_US = 15_000_000


def _files(spark, d):
    """A listing of runs: each document is a file of the run of its source, some of the root itself."""
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "dataset/metadata.csv").when(i % 5 == 1, F.concat(F.lit("visualizations/"), i.cast("string"), F.lit(".png"))).when(i % 5 == 2, F.concat(F.lit("concatenated_audio_solo_verified/"), i.cast("string"), F.lit(".WAV"))).when(i % 5 == 3, F.concat(F.lit("dataset/wavs/spk"), (i % 3).cast("string"), F.lit("/"), i.cast("string"), F.lit(".wav"))).otherwise(F.concat(F.lit("deep/a/b/c/d/"), i.cast("string")))
    run = F.when(i % 41 == 0, "").otherwise(F.concat("source", F.lit("_run/")))
    return table(spark, d, "documents").select(F.concat(F.lit("/out/"), run, kind).alias("path"), (i * 7919 % 1_000_003).alias("modified_us"))


def cat_review_runs(spark, d):
    """Runs that can be reviewed, newest first."""
    return ca.runs(_files(spark, d), "/out/").orderBy(F.col("modified_us").desc(), "run")


def cat_newest_metadata(spark, d):
    return ca.newest_below(_files(spark, d), "/out", "metadata.csv")


def cat_visuals(spark, d):
    """Pictures by name, sixty at most, with the number of all."""
    found = _files(spark, d).filter("path like '%/visualizations/%'").select("path").distinct()
    return ca.capped(found, ["path"], 60)


def cat_metadata(spark, d):
    """Metadata lines for the browser: the first of each run by id, and how many there are."""
    lines = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(" |"), "text")).when(F.col("doc_id") % 10 == 1, F.col("source")).otherwise(F.concat_ws("|", F.col("doc_id").cast("string"), "text", F.lit("x|y"))).alias("value"))
    return ca.capped(rd.metadata_rows(lines, ["source", "doc_id"]), ["doc_id"], MOST_CLIPS).select("doc_id", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "total")


def cat_clip_paths(spark, d):
    """Where a clip's file is: under its id with the ending, if the listing has it, else under the id."""
    docs = table(spark, d, "documents")
    clips = docs.select("doc_id", F.lit("/w").alias("folder"), F.col("doc_id").cast("string").alias("id"))
    return ca.clip_paths(clips, docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("/w/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))).select("doc_id", "wav")


def cat_slice_pairs(spark, d):
    """Verified slices with their high-quality version; those without one go."""
    rows = turns(spark, d)
    fine = rows.filter("turn_id % 4 <> 0").select("turn_id", tx.segment_name(F.col("turn_id"), F.col("s_us"), F.col("e_us")).alias("fine"))
    return ca.paired(rows.filter("turn_id % 2 = 0").select("turn_id", "spk"), fine, "turn_id").select("turn_id", "spk", "fine")


def cat_first_seen(spark, d):
    return ca.first_seen(turns(spark, d), ["rec"], "spk", ["s_us", "turn_id"])


def cat_bars(spark, d):
    total = turns(spark, d).groupBy("rec", "spk").agg(F.sum(F.col("e_us") - F.col("s_us")).alias("talk_us"))
    return ca.bars(total, ["rec"], "spk", "click")


def txt_order_by_start(spark, d):
    """Slices in the order of the start in their name; names without one come first, in the order given."""
    from pyspark.sql import Window

    named = turns(spark, d).select("rec", "turn_id", F.when(F.col("turn_id") % 10 == 0, "unnamed").otherwise(tx.segment_name(F.col("turn_id"), F.col("s_us"), F.col("e_us"))).alias("base"))
    order = Window.partitionBy("rec").orderBy(tx.times_of_name(F.col("base"))[0], "turn_id")
    return named.select("rec", "turn_id", (F.row_number().over(order) - 1).alias("nth"))


def txt_labels(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 9_000 / 10).alias("s"), (F.col("o_orderkey") * 7_919 % 9_000_000).alias("ms"))
    return rows.select("o_orderkey", tx.length_label(F.col("s") * 10).alias("length"), tx.clock_label(F.col("ms")).alias("clock"))


#: Brackets of a log line and what is left of them.
TAGS = [("[bold]", ""), ("[/bold]", ""), ("[link]", "[link]"), ("[GREY42]", ""), ("[#12ab3F on red]", ""), ("[#12ab3]", "[#12ab3]"), ("[on blue]", ""), ("[only]", "[only]"), ("[/]", ""), ("[1]", "[1]"), ("[/Italic red]", ""), ("[ bold]", "[ bold]"), ("[]", "[]"), ("[underline]", ""), ("plain]", "plain]"), ("[/link]", "[/link]")]


def txt_rich_stripped(spark, d):
    """A log line of each document: its text between tags that vary by id, one of them inside another bracket."""
    tags = F.array(*[F.lit(t) for t, _ in TAGS])
    said = F.translate(F.coalesce("text", F.lit("")), "[]", "")
    pick = lambda step: F.get(tags, F.pmod(F.col("doc_id") * step, F.lit(len(TAGS))).cast("int"))
    line = F.concat(pick(1), said, pick(3), F.lit("[x "), pick(5), F.lit("end"))
    return table(spark, d, "documents").select("doc_id", tx.rich_stripped(line).alias("plain"))


def txt_spoken_forms(spark, d):
    """Ordinals and abbreviations as they are read aloud: numbers of the orders with every ending."""
    n = F.col("o_orderkey") % 123
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("st", "nd", "rd", "th", "")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    said = F.concat(F.lit("Dr. Who and  Mrs. X came "), n.cast("string"), suffix, F.lit(" of 007, Prof. Y"))
    return table(spark, d, "orders").select("o_orderkey", tx.normalize_en(said).alias("spoken"))


def snk_reference_manifest(spark, d):
    speech = iv.union(turns(spark, d), ["rec"]).select("rec", "s_us", "e_us")
    return si.reference_rows(speech, ["rec"], [F.col("s_us") - F.col("e_us"), "s_us"])


def src_candidates(spark, d):
    """Candidates of manifest lines; some lines are short, some have no number, some clips are missing."""
    i = F.col("doc_id")
    line = F.when(i % 7 == 0, "1.0,2.0").when(i % 11 == 0, F.concat(F.lit("x,2,1.5,c"), i.cast("string"))).otherwise(F.concat((i / 8).cast("string"), F.lit(",9,"), (i / 4).cast("string"), F.lit(", c"), i.cast("string"), F.lit(" ,more")))
    fields = table(spark, d, "documents").select("doc_id", F.split(line, ",").alias("f")).select("doc_id", *[F.get("f", F.lit(k)).alias(f"c{k}") for k in range(4)])
    there = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("name"))
    return rd.candidate_rows(fields, ["doc_id"]).join(there, "name", "left_semi").select("doc_id", "name", "s_us", "dur_us")


def src_turn_structs(spark, d):
    """Turns given as structs, in one list for each channel."""
    told = F.struct((F.col("s_us") / 1_000_000).alias("start"), (F.col("e_us") / 1_000_000).alias("end"), F.col("spk").alias("speaker"))
    rows = turns(spark, d).select("turn_id", F.array(F.array(told), F.array(told, F.struct(F.lit(5.0).alias("start"), F.lit(5.0).alias("end"), F.lit("z").alias("speaker")))).alias("turns"))
    return rd.turn_structs(rows, "turn_id", "turns").select("turn_id", "track", "spk", "s_us", "e_us")


def rule_precision(spark, d):
    asked, major = _precision_columns()
    return table(spark, d, "customer").select("c_custkey", ru.precision(asked, major).alias("precision"))


def _precision_columns():
    k = F.col("c_custkey")
    asked = F.element_at(F.array(*[F.lit(x) for x in ("auto", "bf16", "FP16", "fp32", "int8", "")], F.lit(None)), (k % 7 + 1).cast("int"))
    return asked, F.when(k % 4 == 0, F.lit(None)).otherwise((k % 4 + 6).cast("int"))


def rule_detected(spark, d):
    """Which detector's spans count, for every mix of failed, empty and heard."""
    i = F.col("doc_id")
    spans = lambda n, at: F.when(n == 0, F.lit(None)).when(n == 1, F.array().cast("array<bigint>")).otherwise(F.array(at))
    policy = F.element_at(F.array(F.lit("first"), F.lit("SECOND"), F.lit("auto"), F.lit(None)), (i % 4 + 1).cast("int"))
    one = ru.detected(policy, spans(F.floor(i / 4) % 3, i), i + 100, spans(F.floor(i / 12) % 3, -i), F.when(i % 5 != 0, i + 200))
    return table(spark, d, "documents").select("doc_id", one.alias("x")).select("doc_id", F.get("x.spans", F.lit(0)).alias("span"), F.size("x.spans").alias("n"), "x.dur_us", "x.used")


def rule_states(spark, d):
    """Settings under two names, what a run lacks, whether it may start, states of set-up rows, names of one model."""
    k = F.col("c_custkey")
    pick = lambda n, value: F.when(k % n != 0, value)
    lacking = ru.missing(pick(5, F.lit("py")), k % 2 == 0, k % 3 == 0, k % 4 == 0, pick(7, F.lit("/r")))
    return table(spark, d, "customer").select(
        "c_custkey",
        ru.setting(F.lit(9), pick(2, k), pick(3, -k)).alias("setting"),
        lacking.alias("lacking"),
        ru.runnable(pick(6, F.lit("/in")), k % 3, F.when(k % 11 == 0, " ").otherwise("x"), lacking, F.when(k % 8 == 0, "running")).alias("runnable"),
        ru.install_state(k % 6 == 0, k % 5 == 0, k % 4 == 0, k % 3).alias("state"),
        ru.same_model(F.concat(F.lit(" Model"), (k % 3).cast("string")), F.concat(F.lit("model"), (k % 2).cast("string"), F.lit(" "))).alias("same"),
        ru.out_of_memory(F.when(k % 2 == 0, "runtime").otherwise("value"), F.when(k % 3 == 0, "CUDA Out of Memory").otherwise("x")).alias("oom"),
    )


def int_halved(spark, d):
    """Chunks halved while they do not fit, down to the floor; how much fits depends on the document."""
    chunks = table(spark, d, "documents").select("doc_id", F.lit(0).cast("long").alias("s_us"), (F.length("text").cast("long") * 40_000).alias("e_us"))
    fits = (F.col("e_us") - F.col("s_us") <= (F.col("doc_id") % 4 + 1) * 20_000_000) & (F.col("doc_id") % 5 != 0)
    return iv.halved(chunks, ["doc_id"], fits, FLOOR_US)


def int_frame_ranges(spark, d):
    spans = turns(spark, d).select("rec", "turn_id", "s_us", "e_us")
    return iv.frame_ranges(spans, F.lit(8_640_000)).select("turn_id", "first", "past")


def int_free_recordings(spark, d):
    """What is free of purchases in every recording, those without any too."""
    return iv.complement(turns(spark, d).filter("spk = 'purchase' and turn_id % 40 = 0"), ["rec"], 86_400_000_000, turns(spark, d).select("rec"))


def aud_peak_db(spark, d):
    clips = vectors(spark, d).select("vec_id")
    return au.peak_db(clips, samples(spark, d).filter("vec_id % 6 <> 0"), "vec_id").select("vec_id", F.round("true_peak_db", 6).alias("true_peak_db"))


def frm_background(spark, d):
    """The loudest background of each vector; the silent level where none is known."""
    levels = fr.frame_levels(samples(spark, d), "vec_id", 8).filter("frame > vec_id % 10")
    found = vectors(spark, d).select("vec_id").join(fr.loudest(levels, "vec_id"), "vec_id", "left")
    return found.select("vec_id", F.round(F.coalesce("level_db", F.lit(fr.SILENT_DB)), 6).alias("level_db"))


def aud_export(spark, d):
    meters = vectors(spark, d).select("vec_id", F.when(F.col("vec_id") % 5 != 0, -(F.col("vec_id") % 40) - 3.0).alias("lufs"), (F.col("vec_id") % 20 - 19.0).alias("true_peak_db"))
    return au.exported(samples(spark, d), meters, "vec_id", 16, 22)


QUERIES = {f.__name__: f for f in (cat_review_runs, cat_newest_metadata, cat_visuals, cat_metadata, cat_clip_paths, cat_slice_pairs, cat_first_seen, cat_bars, txt_order_by_start, txt_labels, txt_rich_stripped, txt_spoken_forms, snk_reference_manifest, src_candidates, src_turn_structs, rule_precision, rule_detected, rule_states, int_halved, int_frame_ranges, int_free_recordings, aud_peak_db, frm_background, aud_export)}

_FILES = """files AS (SELECT '/out/' || CASE WHEN doc_id % 41 = 0 THEN '' ELSE source || '_run/' END || CASE doc_id % 5 WHEN 0 THEN 'dataset/metadata.csv' WHEN 1 THEN 'visualizations/' || doc_id || '.png'
  WHEN 2 THEN 'concatenated_audio_solo_verified/' || doc_id || '.WAV' WHEN 3 THEN 'dataset/wavs/spk' || doc_id % 3 || '/' || doc_id || '.wav' ELSE 'deep/a/b/c/d/' || doc_id END AS path, doc_id * 7919 % 1000003 AS modified_us FROM documents)"""
_RUNS = f"""{_FILES}, rests AS (
  SELECT '/out' AS run, substr(path, 6) AS rest, modified_us FROM files UNION ALL
  SELECT '/out/' || split_part(substr(path, 6), '/', 1), substr(path, 6 + instr(substr(path, 6), '/')), modified_us FROM files WHERE contains(substr(path, 6), '/')),
found AS (SELECT run, min(nullif(regexp_extract(rest, '^dataset/wavs/([^/]+)/', 1), '')) AS speaker, bool_or(rest = 'dataset/metadata.csv') AS has_dataset, bool_or(starts_with(rest, 'visualizations/')) AS has_visuals,
  bool_or(regexp_matches(rest, '(?i)^concatenated_audio_solo_verified/[^/]+[.]wav$')) AS has_solo, max(modified_us) AS modified_us FROM rests GROUP BY run)"""
_NAME = "printf('solo_temp_verif_%04d_%dp%03ds_to_%dp%03ds', turn_id, (s_us + 500) // 1000 // 1000, (s_us + 500) // 1000 % 1000, (e_us + 500) // 1000 // 1000, (e_us + 500) // 1000 % 1000)"
_ORDINALS = "['" + "', '".join(tx.ORDINALS) + "']"
_MS = "printf('%d.%03d', ({c} + 500) // 1000 // 1000, ({c} + 500) // 1000 % 1000)"

ORACLE_SQL = {
    "cat_review_runs": f"WITH {_RUNS} SELECT run, coalesce(speaker, split_part(split_part(run, '/', -1), '_', 1)) AS speaker, has_dataset, has_visuals, has_solo, modified_us FROM found WHERE has_dataset OR has_visuals OR has_solo",
    "cat_newest_metadata": f"WITH {_FILES} SELECT path, modified_us FROM files WHERE path LIKE '%/metadata.csv' AND len(string_split(substr(path, 6), '/')) - 1 <= 4 ORDER BY modified_us DESC, path DESC LIMIT 1",
    "cat_visuals": f"WITH {_FILES}, v AS (SELECT DISTINCT path FROM files WHERE contains(path, '/visualizations/')) SELECT path, (SELECT count(*) FROM v) AS total FROM v ORDER BY path LIMIT 60",
    "cat_metadata": f"WITH kept AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, md5(trim(coalesce(split_part(text, '|', 1), 'x'))) AS text_md5 FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 1) SELECT *, (SELECT count(*) FROM kept) AS total FROM kept ORDER BY doc_id LIMIT {MOST_CLIPS}",
    "cat_clip_paths": "SELECT doc_id, '/w/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.wav' ELSE '' END AS wav FROM documents",
    "cat_slice_pairs": f"WITH {TURNS_SQL} SELECT turn_id, spk, {_NAME} AS fine FROM turns WHERE turn_id % 2 = 0 AND turn_id % 4 <> 0",
    "cat_first_seen": f"WITH {TURNS_SQL}, f AS (SELECT rec, spk, min((s_us, turn_id)) AS first FROM turns GROUP BY rec, spk) SELECT rec, spk, row_number() OVER (PARTITION BY rec ORDER BY first, spk) - 1 AS nth FROM f",
    "cat_bars": f"WITH {TURNS_SQL}, t AS (SELECT rec, spk, CAST(sum(e_us - s_us) AS BIGINT) AS talk_us FROM turns GROUP BY rec, spk) SELECT *, row_number() OVER (PARTITION BY rec ORDER BY spk <> 'click', spk) - 1 AS bar FROM t",
    "txt_order_by_start": f"WITH {TURNS_SQL} SELECT rec, turn_id, row_number() OVER (PARTITION BY rec ORDER BY CASE WHEN turn_id % 10 = 0 THEN 0 ELSE (s_us + 500) // 1000 END, turn_id) - 1 AS nth FROM turns",
    "txt_labels": """WITH r AS (SELECT o_orderkey, (o_orderkey * 37 % 9000 / 10) * 10 AS s, o_orderkey * 7919 % 9000000 // 1000 AS t FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s / 60) AS BIGINT) % 60) ELSE printf('%d:%02d', CAST(floor(s / 60) AS BIGINT), CAST(floor(s % 60 + 0.5) AS BIGINT)) END AS length,
CASE WHEN t >= 3600 THEN printf('%d:', t // 3600) ELSE '' END || printf('%02d:%02d', t // 60 % 60, t % 60) AS clock FROM r""",
    "txt_rich_stripped": f"""WITH tag(i, shown) AS (VALUES {", ".join(f"({i}, '{shown}')" for i, (_, shown) in enumerate(TAGS))})
SELECT doc_id, a.shown || translate(coalesce(text, ''), '[]', '') || b.shown || '[x ' || c.shown || 'end' AS plain
FROM documents JOIN tag a ON a.i = doc_id % {len(TAGS)} JOIN tag b ON b.i = doc_id * 3 % {len(TAGS)} JOIN tag c ON c.i = doc_id * 5 % {len(TAGS)}""",
    "txt_spoken_forms": f"""WITH n AS (SELECT o_orderkey, o_orderkey % 123 AS n, ['st', 'nd', 'rd', 'th', ''][o_orderkey % 5 + 1] AS suffix FROM orders),
s AS (SELECT *, CASE WHEN n < 20 THEN {tx.SMALL}[n + 1] WHEN n < 100 THEN {tx.TENS}[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || {tx.SMALL}[n % 10 + 1] ELSE '' END ELSE 'one hundred' || CASE WHEN n % 100 = 0 THEN '' WHEN n % 100 < 20 THEN ' ' || {tx.SMALL}[n % 100 + 1] ELSE ' ' || {tx.TENS}[n % 100 // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || {tx.SMALL}[n % 10 + 1] ELSE '' END END END AS spelled FROM n)
SELECT o_orderkey, 'Doctor Who and Missus X came ' || CASE WHEN suffix = '' THEN spelled WHEN n BETWEEN 1 AND 20 THEN {_ORDINALS}[n] ELSE n || suffix END || ' of seven, Professor Y' AS spoken FROM s""",
    "snk_reference_manifest": f"""WITH {TURNS_SQL}, {islands('turns', 'u', 'rec')}, r AS (SELECT rec, s_us, e_us, row_number() OVER (PARTITION BY rec ORDER BY s_us - e_us, s_us) - 1 AS nth FROM u)
SELECT rec, nth, {_MS.format(c='s_us')} AS start_s, {_MS.format(c='e_us')} AS end_s, {_MS.format(c='(e_us - s_us)')} AS duration_s,
printf('ref_%03d_%.1fs-%.1fs.wav', nth, s_us / 1000000, e_us / 1000000) AS filename FROM r""",
    "src_candidates": "SELECT doc_id, 'c' || doc_id AS name, CAST(round(doc_id / 8 * 1000000) AS BIGINT) AS s_us, CAST(round(doc_id / 4 * 1000000) AS BIGINT) AS dur_us FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 2 = 0",
    "src_turn_structs": f"WITH {TURNS_SQL} SELECT turn_id, CAST(x.t AS INT) AS track, spk, s_us, e_us FROM turns, (VALUES (0), (1)) AS x(t)",
    "rule_precision": """WITH c AS (SELECT c_custkey, ['auto', 'bf16', 'FP16', 'fp32', 'int8', '', NULL][c_custkey % 7 + 1] AS asked, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 + 6 END AS major FROM customer)
SELECT c_custkey, CASE WHEN asked = 'auto' AND major IS NULL THEN 'fp32' WHEN asked = 'auto' AND major >= 8 THEN 'bf16' WHEN asked = 'auto' THEN 'fp16' WHEN asked = 'bf16' AND major < 8 THEN 'fp16' WHEN asked = 'bf16' THEN 'bf16' WHEN asked = 'FP16' THEN 'fp16' ELSE 'fp32' END AS precision FROM c""",
    "rule_detected": """WITH c AS (SELECT doc_id, ['first', 'second', 'auto', 'auto'][doc_id % 4 + 1] AS way, doc_id // 4 % 3 AS a, doc_id // 12 % 3 AS b, doc_id + 100 AS a_us, CASE WHEN doc_id % 5 <> 0 THEN doc_id + 200 ELSE 0 END AS b_us FROM documents),
u AS (SELECT *, CASE WHEN way = 'second' THEN CASE WHEN b = 2 THEN 'second' ELSE 'none' END WHEN a = 2 THEN 'first' WHEN way = 'first' THEN 'none' WHEN b = 2 THEN 'second' ELSE 'none' END AS used FROM c)
SELECT doc_id, CASE used WHEN 'first' THEN doc_id WHEN 'second' THEN -doc_id END AS span, CASE WHEN used = 'none' THEN CASE WHEN way = 'second' AND a = 0 AND b = 0 OR way <> 'second' AND a = 0 AND b = 0 THEN NULL ELSE 0 END ELSE 1 END AS n,
CASE used WHEN 'first' THEN a_us WHEN 'second' THEN CASE WHEN b_us > 0 OR way = 'second' THEN b_us WHEN a > 0 THEN a_us ELSE 0 END
  ELSE CASE way WHEN 'second' THEN CASE WHEN b > 0 THEN b_us ELSE 0 END WHEN 'first' THEN CASE WHEN a > 0 THEN a_us ELSE 0 END ELSE CASE WHEN b > 0 THEN b_us WHEN a > 0 THEN a_us ELSE 0 END END END AS dur_us, used FROM u""",
    "rule_states": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'python' WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN 'decoder' WHEN c_custkey % 7 = 0 THEN 'folder' ELSE '' END AS lacking FROM customer)
SELECT k AS c_custkey, CASE WHEN k % 2 <> 0 THEN k WHEN k % 3 <> 0 THEN -k ELSE 9 END AS setting, lacking, k % 6 <> 0 AND k % 3 > 0 AND k % 11 <> 0 AND lacking = '' AND k % 8 <> 0 AS runnable,
CASE WHEN k % 6 = 0 THEN 'ok' WHEN k % 5 = 0 THEN 'installing' WHEN k % 4 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'install' ELSE 'blocked' END AS state, k % 3 = k % 2 AS same, k % 2 = 0 AND k % 3 = 0 AS oom FROM c""",
    "int_halved": f"""WITH RECURSIVE c(doc_id, s_us, e_us) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(length(text) AS BIGINT) * 40000 FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unnest([s_us, s_us + (e_us - s_us) // 2 + 1000]), unnest([s_us + (e_us - s_us) // 2 + 1000, e_us]) FROM c
  WHERE NOT (e_us - s_us <= (doc_id % 4 + 1) * 20000000 AND doc_id % 5 <> 0) AND e_us - s_us > {2 * FLOOR_US}),
j AS (SELECT *, e_us - s_us <= (doc_id % 4 + 1) * 20000000 AND doc_id % 5 <> 0 AS fits FROM c)
SELECT doc_id, s_us, e_us, NOT fits AS skipped FROM j WHERE fits OR e_us - s_us <= {2 * FLOOR_US}""",
    "int_frame_ranges": f"WITH {TURNS_SQL} SELECT turn_id, CAST(round_even(s_us * 100 / 1000000, 0) AS BIGINT) AS first, least(8640000, CAST(round_even(e_us * 100 / 1000000, 0) AS BIGINT) + 1) AS past FROM turns",
    "int_free_recordings": f"""WITH {TURNS_SQL}, cut AS (SELECT rec, s_us, least(e_us, 86400000000) AS e_us FROM turns WHERE spk = 'purchase' AND turn_id % 40 = 0 AND least(e_us, 86400000000) > s_us),
{islands("cut", "held", "rec")},
free AS (SELECT rec, coalesce(lag(e_us) OVER (PARTITION BY rec ORDER BY s_us), 0) AS s_us, s_us AS e_us FROM held
  UNION ALL SELECT r.rec, coalesce(max(h.e_us), 0), 86400000000 FROM (SELECT DISTINCT rec FROM turns) r LEFT JOIN held h ON r.rec = h.rec GROUP BY r.rec)
SELECT rec, s_us, e_us FROM free WHERE e_us > s_us""",
    "aud_peak_db": "SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN CAST(-200 AS DOUBLE) ELSE round(log10(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) + 1e-10) * 20, 6) END AS true_peak_db FROM embeddings",
    "aud_export": AUDIO_SQL["aud_resample"].replace("SELECT p.vec_id, p.pos, round(a.x + (coalesce(b.x, a.x) - a.x) * (t - floor(t)), 6) AS x FROM p", ", x AS (SELECT p.vec_id, p.pos, a.x + (coalesce(b.x, a.x) - a.x) * (t - floor(t)) AS x FROM p")
    + """),
g AS (SELECT vec_id, vec_id % 20 - 19.0 AS tp, CASE WHEN vec_id % 5 <> 0 THEN least(12.0, greatest(-12.0, -23.0 + vec_id % 40 + 3.0)) ELSE 0.0 END AS gain FROM embeddings)
SELECT vec_id, pos, CAST(round_even(greatest(-1.0, least(1.0, x * pow(CAST(10 AS DOUBLE), CAST(gain - CASE WHEN gain = 0 THEN 0 ELSE greatest(0, tp + gain + 1) END AS DOUBLE) / 20))) * 32767, 0) AS INT) AS pcm FROM x JOIN g USING (vec_id)""",
    "frm_background": "WITH f AS (SELECT vec_id, k AS frame, log10(sqrt(list_sum(list_transform(embedding[k * 8 + 1 : k * 8 + 8], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 8 + 1e-10) + 1e-10) * 20 AS db FROM embeddings, range(8) AS r(k)) SELECT vec_id, round(coalesce(max(db) FILTER (WHERE frame > vec_id % 10), -120.0), 6) AS level_db FROM f GROUP BY vec_id",
}
