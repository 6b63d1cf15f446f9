"""From turns, speech spans, samples and voice prints to a dataset: the whole extraction as one plan.

Recordings are the vectors of a label and a block of ids, laid end to end: 64
samples (80 ms) each.  Every fourth vector is another speaker's turn, and turns
run over into the next.  Transcripts are documents.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion as fu
from quillon.operators import gate as ga
from quillon.operators import intervals as iv
from quillon.operators import segmenter as sg
from quillon.operators import vectors as ve
from quillon.plans import dataset as ds
from quillon.plans.corpus_queries import REGION_IDS, SHORT
from quillon.plans.domain import table, vectors
from quillon.plans.shared import materialised

TARGET = "ann"
#: Samples a second, and the length of a vector.
RATE = 800
VECTOR_US = 80_000
#: Bounds of a clip's length, and the least score of the target's voice.
LIMITS = ga.Thresholds(min_us=50_000, max_us=450_000)
ACCEPT = 0.15


def _placed(spark, d):
    """``rec, nth, vec_id, v, spk``: each vector's recording and place in it."""
    rows = vectors(spark, d)
    rec = F.concat(F.col("label").cast("string"), F.lit("/"), F.floor(F.col("vec_id") / REGION_IDS).cast("string"))
    nth = F.row_number().over(Window.partitionBy("rec").orderBy("vec_id")) - 1
    return rows.withColumn("rec", rec).withColumn("nth", nth).select("rec", "nth", "vec_id", "v", F.when(F.col("vec_id") % 4 == 0, "bob").otherwise(TARGET).alias("spk"))


def turns_of(placed):
    """``rec, spk, turn_id, s_us, e_us``; a turn runs up to 20 ms into the next."""
    s = F.col("nth") * VECTOR_US
    return placed.select("rec", "spk", F.col("vec_id").alias("turn_id"), s.alias("s_us"), (s + VECTOR_US + F.col("vec_id") % 3 * 10_000).alias("e_us"))


def speech_of(placed):
    """``rec, s_us, e_us``: two spans of speech in each vector's time."""
    at = lambda frame: F.col("nth") * VECTOR_US + frame * 10_000
    pair = F.array(*[F.struct(at(F.col("vec_id") % m + a).alias("s_us"), at(F.col("vec_id") % m + a + 2).alias("e_us")) for m, a in ((3, 0), (5, 3))])
    return placed.select("rec", F.explode(pair).alias("x")).select("rec", "x.*")


def clips_of(placed):
    """Word-safe clips of the target's solo speech."""
    samples = placed.select("rec", "nth", F.posexplode("v").alias("i", "x")).select("rec", (F.col("nth") * 64 + F.col("i")).alias("pos"), "x")
    totals = placed.groupBy("rec").agg((F.count("*") * VECTOR_US).alias("total_us"))
    alone = iv.solo(turns_of(placed), TARGET)
    return sg.cut_recordings(alone, speech_of(placed), samples, totals, RATE, SHORT, LIMITS.min_us)


def seg_cut(spark, d):
    """Clips cut from turns, speech and samples, in microseconds."""
    found = clips_of(_placed(spark, d))
    return found.withColumns({"first_db": F.round("first_db", 6), "past_db": F.round("past_db", 6)})


def scored(clips, placed):
    """Clips with the fused score of their voice against the target's, and the first vector they hold.

    The target's prototype is the mean of its first second in the recording.
    """
    prefix = ve.talk_time_prefix(turns_of(placed).filter(F.col("spk") == TARGET), ["rec", "spk"], 1.0)
    target = ve.centroid(placed.join(prefix.select(F.col("turn_id").alias("vec_id")), "vec_id"), ["rec"]).select("rec", F.col("centroid").alias("p"))
    spoken = placed.select("rec", "vec_id", "v", (F.col("nth") * VECTOR_US).alias("s_us"), ((F.col("nth") + 1) * VECTOR_US).alias("e_us"))
    key = ["rec", "region_id", "clip"]
    met = iv.range_join(clips.select(*key, "s_us", "e_us"), spoken, "rec", 10_000_000).select(*[F.col(f"l_{k}").alias(k) for k in key], F.col("r_vec_id").alias("vec_id"), F.col("r_v").alias("v"))
    voice = ve.centroid(met, key).drop("n").join(met.groupBy(*key).agg(F.min("vec_id").alias("doc_id")), key).join(target, "rec")
    part = lambda a, n: ve.cosine(F.slice("centroid", a, n), F.slice("p", a, n))
    score = fu.weighted([part(1, 32), part(33, 16), part(49, 16)], fu.activity_factor(F.lit(1.0)))
    return clips.join(voice.select(*key, "doc_id", score.alias("score")), key)


def extract_end_to_end(spark, d):
    """Turns to solo speech, word-safe clips, verified voices, transcripts, gate, dataset with a split."""
    placed = _placed(spark, d)
    # clips come out of a Python walk, so they are written before they are read several times
    clips = materialised(clips_of(placed))
    found = fu.split_accepted(materialised(scored(clips, placed)), "score", ACCEPT)
    number = F.row_number().over(Window.partitionBy("rec").orderBy("region_id", "clip")) - 1
    name = tx.final_name(tx.segment_name(F.col("nth"), F.col("s_us"), F.col("e_us")), F.lit(TARGET))
    clip_id = F.concat(F.replace("rec", F.lit("/"), F.lit("_")), F.lit("_"), name)
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("transcript"), F.col("lang").alias("language"))
    candidates = found.withColumn("nth", number).join(docs, "doc_id").select(clip_id.alias("clip_id"), "transcript", F.lit(TARGET).alias("speaker"), "language", (F.col("e_us") - F.col("s_us")).alias("dur_us"), F.col("validated").alias("silence_validated"), F.col("accepted").alias("verified"))
    kept = ds.rows(ga.judged(candidates, LIMITS))
    return ds.split_by_hash(kept, 0.1).select("clip_id", "speaker", "dur_us", "normalized", "is_eval")


QUERIES = {f.__name__: f for f in (seg_cut, extract_end_to_end)}
ORACLE_SQL: dict[str, str] = {}
