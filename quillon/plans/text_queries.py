"""Registered text, gate and export queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import gate as ga
from quillon.plans import dataset as ds
from quillon.plans.domain import CLIPS_SQL, TURNS_SQL, clips, table, turns
from quillon.operators.intervals import at_least

EVAL = 0.1


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def txt_normalize_en(spark, d):
    return _docs(spark, d).select("doc_id", tx.normalize_en(F.col("text")).alias("normalized"))


def txt_normalize_ar(spark, d):
    return _docs(spark, d).select("doc_id", tx.normalize_ar(F.translate("text", "0123456789", tx.AR_DIGITS[:10])).alias("normalized"))


def txt_spelled_ids(spark, d):
    n = F.col("o_orderkey") % 10000
    return table(spark, d, "orders").select("o_orderkey", tx.int_words(n).alias("english"), tx.ar_int_words(n).alias("arabic"))


def txt_newline_safe(spark, d):
    return _docs(spark, d).select("doc_id", tx.one_line(F.col("text")).alias("line"))


def txt_strip_tag(spark, d):
    tagged = F.concat(F.replace("text", F.lit("."), F.lit(". <en-US> ")), F.lit(" <de-DE>"))
    return _docs(spark, d).select("doc_id", tx.strip_tags(tagged).alias("clean"))


def txt_locale(spark, d):
    tag = F.element_at(F.array(*[F.lit(x) for x in ("", "AUTO", "pt-BR", "zz", " DE ")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", tx.locale(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(tag)).alias("locale"))


def txt_safe_filename(spark, d):
    return _docs(spark, d).select("doc_id", tx.safe_file_name(F.col("text")).alias("name"))


def _named(spark, d):
    return turns(spark, d).select("turn_id", tx.segment_name(F.col("turn_id") % 100000, F.col("s_us"), F.col("e_us")).alias("base"))


def txt_basename(spark, d):
    return _named(spark, d).select("turn_id", "base", tx.final_name(F.col("base"), F.lit("target")).alias("final"))


def txt_parse_times(spark, d):
    s, e = tx.times_of_name(F.col("base"))
    return _named(spark, d).select("turn_id", s.alias("s_us"), e.alias("e_us"))


def txt_csv_quote(spark, d):
    return _docs(spark, d).select("doc_id", tx.csv_field(F.col("text")).alias("field"))


def txt_format_duration(spark, d):
    return turns(spark, d).select("turn_id", tx.clock(F.col("s_us")).alias("starts"), tx.clock(F.col("s_us") * 100).alias("long_form"))


def txt_log_class(spark, d):
    marked = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("Initializing pipeline "), "text")).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("== STAGE 6.5a: "), "text")).when(F.col("doc_id") % 17 == 0, F.concat(F.lit("Initializing model failed "), "text")).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("WARNing "), "text")).when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" Failed"))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", tx.log_class(marked).alias("kind"), tx.stage_of(marked).alias("stage"))


def txt_size_label(spark, d):
    return _docs(spark, d).select("doc_id", tx.size_label(F.octet_length("text").cast("long") * 997).alias("label"))


def txt_word_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words"))


def _judged(spark, d):
    return ga.judged(clips(spark, d))


def _dataset(spark, d, in_order=False):
    return ds.rows(_judged(spark, d), in_order)


def dataset_metadata(spark, d):
    """Flagship: accepted clips with transcript and normalised transcript, by id."""
    return _dataset(spark, d, in_order=True).select("clip_id", "transcript", "normalized")


def ds_csv(spark, d):
    return _dataset(spark, d, in_order=True).select("clip_id", ds.csv_line().alias("value"))


def ds_jsonl(spark, d):
    return _dataset(spark, d).select("clip_id", ds.json_line().alias("value"))


def _split(spark, d):
    return ds.split_by_hash(_dataset(spark, d), EVAL)


def ds_train(spark, d):
    return _split(spark, d).filter("not is_eval").select("clip_id", "normalized")


def ds_eval(spark, d):
    return _split(spark, d).filter("is_eval").select("clip_id", "normalized")


def ds_eval_seeded(spark, d):
    return ds.split_seeded(_dataset(spark, d), EVAL).filter("is_eval").select("clip_id", "normalized")


def gate_reasons(spark, d):
    return _judged(spark, d).select("clip_id", "accepted", F.array_join(F.array_sort(F.map_keys("reasons")), ",").alias("why"))


def gate_counts(spark, d):
    return ga.reason_counts(_judged(spark, d))


def gate_summary(spark, d):
    return ds.summary(_judged(spark, d), _split(spark, d))


QUERIES = {f.__name__: f for f in (dataset_metadata, txt_normalize_en, txt_normalize_ar, txt_spelled_ids, txt_newline_safe, txt_strip_tag, txt_locale, txt_safe_filename, txt_basename, txt_parse_times, txt_csv_quote, txt_format_duration, txt_log_class, txt_size_label, txt_word_counts, gate_reasons, gate_counts, gate_summary, ds_csv, ds_jsonl, ds_train, ds_eval, ds_eval_seeded)}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _small(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN {_list(tx.SMALL)}[{n} + 1] ELSE {_list(tx.TENS)}[{n} // 10 - 1] || CASE WHEN {n} % 10 > 0 THEN '-' || {_list(tx.SMALL)}[{n} % 10 + 1] ELSE '' END END"


def _spelled(n: str) -> str:
    return f"concat_ws(' ', CASE WHEN {n} >= 1000 THEN {_list(tx.SMALL)}[{n} // 1000 + 1] || ' thousand' END, CASE WHEN {n} // 100 % 10 > 0 THEN {_list(tx.SMALL)}[{n} // 100 % 10 + 1] || ' hundred' END, CASE WHEN {n} % 100 > 0 OR {n} = 0 THEN {_small(f'({n} % 100)')} END)"


def _spelled_ar(n: str) -> str:
    r = f"({n} % 100)"
    below = f"CASE WHEN {r} < 10 THEN {_list(tx.AR_ONES)}[{r}] WHEN {r} < 20 THEN {_list(tx.AR_TEENS)}[{r} - 9] WHEN {r} % 10 = 0 THEN {_list(tx.AR_TENS)}[{r} // 10 - 1] ELSE {_list(tx.AR_ONES)}[{r} % 10] || '{tx.AR_AND}' || {_list(tx.AR_TENS)}[{r} // 10 - 1] END"
    thousand = f"CASE {n} // 1000 WHEN 1 THEN '{tx.AR_THOUSAND}' WHEN 2 THEN '{tx.AR_TWO_THOUSAND}' ELSE {_list(tx.AR_ONES)}[{n} // 1000] || ' {tx.AR_THOUSANDS}' END"
    return f"CASE WHEN {n} = 0 THEN '{tx.AR_ZERO}' ELSE concat_ws('{tx.AR_AND}', CASE WHEN {n} >= 1000 THEN {thousand} END, CASE WHEN {n} // 100 % 10 > 0 THEN {_list(tx.AR_HUNDREDS)}[{n} // 100 % 10] END, CASE WHEN {r} > 0 THEN {below} END) END"


def _expanded(text: str, spelled) -> str:
    """Integers of a text in words: what lies between them and their words, zipped."""
    value = "TRY_CAST(p[2] AS BIGINT)"
    return rf"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '\b\d+\b'), regexp_extract_all({text}, '\b\d+\b')), lambda p: p[1] || coalesce(CASE WHEN {value} <= 9999 THEN {spelled(value)} ELSE p[2] END, '')), '')"


def _line(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


_ABBREVIATED = "coalesce(text, '')"
for _short, _full in tx.ABBREVIATIONS.items():
    _ABBREVIATED = rf"regexp_replace({_ABBREVIATED}, '\b{_short}\.', '{_full}', 'g')"
# the driver's texts have no ordinals
_NORMAL = f"normal AS (SELECT doc_id, {_line('x')} AS normalized FROM (SELECT doc_id, {_expanded('s', _spelled)} AS x FROM (SELECT doc_id, {_ABBREVIATED} AS s FROM documents)))"
_GATED = f"""{CLIPS_SQL}, {_NORMAL},
judged AS (SELECT c.*, n.normalized, list_filter([
  CASE WHEN n.normalized = '' OR trim(coalesce(transcript, '')) = '' THEN 'empty_transcript' END, CASE WHEN dur_us < 1000000 THEN 'duration_too_short' END,
  CASE WHEN dur_us > 15000000 THEN 'duration_too_long' END, CASE WHEN NOT silence_validated THEN 'not_silence_validated' END,
  CASE WHEN NOT verified THEN 'not_verified' END], lambda r: r IS NOT NULL) AS reasons FROM clips c JOIN normal n USING (doc_id)),
dataset AS (SELECT clip_id, {_line("coalesce(transcript, '')")} AS transcript, normalized, speaker, language, dur_us FROM judged WHERE len(reasons) = 0),
split AS (SELECT *, row_number() OVER (ORDER BY sha1(clip_id || '1234'), clip_id) <= round_even(count(*) OVER () * 0.1, 0) AS is_eval FROM dataset)"""
_BASE = f"""{TURNS_SQL}, named AS (SELECT turn_id, (s_us + 500) // 1000 AS a, (e_us + 500) // 1000 AS b,
  printf('solo_temp_verif_%04d_%dp%03ds_to_%dp%03ds', turn_id % 100000, (s_us + 500) // 1000 // 1000, (s_us + 500) // 1000 % 1000, (e_us + 500) // 1000 // 1000, (e_us + 500) // 1000 % 1000) AS base FROM turns)"""
_CLOCK = "printf('%02d:%02d:%02d.%03d', {t} // 3600000000, {t} // 60000000 % 60, {t} // 1000000 % 60, {t} // 1000 % 1000)"
_MARKED = "m AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Initializing pipeline ' || text WHEN doc_id % 11 = 0 THEN '== STAGE 6.5a: ' || text WHEN doc_id % 17 = 0 THEN 'Initializing model failed ' || text WHEN doc_id % 7 = 0 THEN 'WARNing ' || text WHEN doc_id % 5 = 0 THEN text || ' Failed' ELSE text END AS line FROM documents)"
_QUOTED = """CASE WHEN regexp_matches({c}, '[|"\\r\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""

ORACLE_SQL = {
    "dataset_metadata": f"WITH {_GATED} SELECT clip_id, transcript, normalized FROM dataset",
    "txt_normalize_en": f"WITH {_NORMAL} SELECT * FROM normal",
    "txt_normalize_ar": f"SELECT doc_id, {_line('x')} AS normalized FROM (SELECT doc_id, {_expanded('s', _spelled_ar)} AS x FROM (SELECT doc_id, regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x{{0610}}-\\x{{061A}}\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}-\\x{{06ED}}\\x{{0640}}]', '', 'g') AS s FROM documents))",
    "txt_spelled_ids": f"SELECT o_orderkey, {_spelled('(o_orderkey % 10000)')} AS english, {_spelled_ar('(o_orderkey % 10000)')} AS arabic FROM orders",
    "txt_newline_safe": f"SELECT doc_id, {_line(chr(39).join(['coalesce(text, ', '', ')']))} AS line FROM documents",
    "txt_strip_tag": r"SELECT doc_id, trim(regexp_replace(replace(text, '.', '. <en-US> ') || ' <de-DE>', '\s*<[a-z]{2}-[A-Z]{2}>\s*', ' ', 'g')) AS clean FROM documents",
    "txt_locale": "WITH l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE ['', 'AUTO', 'pt-BR', 'zz', ' DE '][doc_id % 5 + 1] END AS tag FROM documents) SELECT doc_id, CASE WHEN coalesce(tag, '') = '' OR lower(tag) = 'auto' THEN 'auto' WHEN contains(tag, '-') THEN trim(tag) ELSE coalesce(CASE lower(trim(tag)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LOCALES.items()) + " END, 'auto') END AS locale FROM l",
    "txt_safe_filename": r"""WITH n AS (SELECT doc_id, left(replace(regexp_replace(text, '[<>:"/\\|?*\x00-\x1F]', '', 'g'), ' ', '_'), 200) AS name FROM documents) SELECT doc_id, CASE WHEN coalesce(name, '') = '' THEN 'unnamed_file' ELSE name END AS name FROM n""",
    "txt_basename": f"WITH {_BASE} SELECT turn_id, base, replace(base, 'solo_temp_verif', 'target_solo_final') AS final FROM named",
    "txt_parse_times": f"WITH {_BASE} SELECT turn_id, a * 1000 AS s_us, b * 1000 AS e_us FROM named",
    "txt_csv_quote": f"SELECT doc_id, {_QUOTED.format(c='text')} AS field FROM documents",
    "txt_format_duration": f"WITH {TURNS_SQL} SELECT turn_id, {_CLOCK.format(t='s_us')} AS starts, {_CLOCK.format(t='(s_us * 100)')} AS long_form FROM turns",
    "txt_log_class": rf"WITH {_MARKED} SELECT doc_id, CASE WHEN contains(line, '== STAGE') OR contains(line, 'Initializing pipeline') THEN 'banner' WHEN regexp_matches(line, '(?i)traceback|error|critical|failed') THEN 'err' WHEN regexp_matches(line, '(?i)warn') THEN 'warn' ELSE 'plain' END AS kind, nullif(regexp_extract(line, '== STAGE (\d+(?:\.\d+)?)[ab]?:', 1), '') AS stage FROM m",
    "txt_size_label": "WITH b AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) * 997 AS n FROM documents) SELECT doc_id, CASE WHEN n > 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n > 1048576 THEN printf('%.1f MB', n / 1048576.0) ELSE CAST(CAST(greatest(1, round(n / 1024.0)) AS BIGINT) AS VARCHAR) || ' KB' END AS label FROM b",
    "txt_word_counts": r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n_words FROM documents",
    "gate_reasons": f"WITH {_GATED} SELECT clip_id, len(reasons) = 0 AS accepted, array_to_string(list_sort(reasons), ',') AS why FROM judged",
    "gate_counts": f"WITH {_GATED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason",
    "gate_summary": f"WITH {_GATED} SELECT (SELECT count(*) FROM judged) AS n_candidates, (SELECT count(*) FROM judged WHERE len(reasons) > 0) AS n_rejected, count(*) AS n_clips, count(*) FILTER (WHERE NOT is_eval) AS n_train, count(*) FILTER (WHERE is_eval) AS n_eval FROM split",
    "ds_csv": f"WITH {_GATED} SELECT clip_id, {_QUOTED.format(c='clip_id')} || '|' || {_QUOTED.format(c='transcript')} || '|' || {_QUOTED.format(c='normalized')} AS value FROM dataset",
    "ds_jsonl": f"""WITH {_GATED} SELECT clip_id, '{{"audio_filepath": ' || to_json('wavs/' || speaker || '/' || clip_id || '.wav') || ', "text": ' || to_json(transcript) || ', "normalized_text": ' || to_json(normalized) || ', "speaker": ' || to_json(speaker) || ', "language": ' || to_json(language) || ', "duration": ' || to_json(round(dur_us / 1000000, 4)) || '}}' AS value FROM dataset""",
    "ds_train": f"WITH {_GATED} SELECT clip_id, normalized FROM split WHERE NOT is_eval",
    "ds_eval": f"WITH {_GATED} SELECT clip_id, normalized FROM split WHERE is_eval",
}
