"""Meters, retries, table functions and large edit distances against plain loops."""

import math
import random

import numpy as np
import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from quillon.functions import table_functions as tf
from quillon.operators import compare as cp
from quillon.operators import meters as mt
from quillon.operators import retries


def plain_loudness(samples, rate):
    """Sample by sample through both sections, then gating blocks by slices."""
    wave = list(samples)
    for b, a in mt.weighting(rate):
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for x in wave:
            y = b[0] * x + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            x1, x2, y1, y2 = x, x1, y, y1
            out.append(y)
        wave = out
    hop = (rate + 5) // 10
    means = [sum(v * v for v in wave[i : i + 4 * hop]) / (4 * hop) for i in range(0, len(wave) - 4 * hop + 1, hop)]
    level = lambda m: -0.691 + 10 * math.log10(m)
    loud = [m for m in means if m > 0 and level(m) > -70]
    if not loud:
        return None
    bound = level(sum(loud) / len(loud)) - 10
    kept = [m for m in loud if level(m) > bound]
    return level(sum(kept) / len(kept))


def recordings(rate):
    t = np.arange(3 * rate) / rate
    rng = np.random.default_rng(4)
    noise = rng.normal(0, 0.1, 2 * rate)
    noise[rate // 2 : rate] *= 0.001
    return {"tone": 0.05 * np.sin(2 * np.pi * 220 * t), "noise": noise, "short": np.full(rate // 5, 0.3), "silence": np.zeros(rate), "none": np.zeros(0)}


def blocks_of(spark, waves, size):
    rows = [(k, i, w[a : a + size].tolist()) for k, w in waves.items() for i, a in enumerate(range(0, max(len(w), 1), size))]
    return spark.createDataFrame(rows, "rec string, block long, samples array<double>").repartition(3)


@pytest.mark.parametrize("size", [997, 100_000])
def test_loudness_equals_a_plain_meter_in_any_blocks(spark, size):
    rate = 8000
    waves = recordings(rate)
    got = {r.rec: r.lufs for r in mt.loudness(blocks_of(spark, waves, size), "rec", rate).collect()}
    want = {k: plain_loudness(w.tolist(), rate) for k, w in waves.items()}
    assert set(got) == set(want) and got["short"] is None and got["silence"] is None and got["none"] is None
    assert all(abs(got[k] - want[k]) < 1e-6 for k in ("tone", "noise"))


def test_a_full_scale_tone_reads_as_the_recommendation_says(spark):
    """A 997 Hz sine at full scale in one channel: -3.01."""
    rate = 48_000
    wave = {"x": np.sin(2 * np.pi * 997 * np.arange(2 * rate) / rate)}
    assert abs(mt.loudness(blocks_of(spark, wave, 1 << 14), "rec", rate).first().lufs + 3.01) < 0.02


@pytest.mark.parametrize("size", [60, 1000, 10_000])
def test_true_peak_between_samples_in_any_blocks(spark, size):
    n = np.arange(2048)
    waves = {"between": 0.5 * np.sin(np.pi / 2 * n + np.pi / 4), "odd": 0.8 * np.sin(2 * np.pi * 0.21 * n + 0.3), "impulse": np.where(n == 1000, 1.0, 0.0), "none": np.zeros(0), "few": np.array([0.25, -0.5, 0.25])}
    got = {r.rec: r.true_peak_db for r in mt.true_peak(blocks_of(spark, waves, size), "rec").collect()}
    whole = {r.rec: r.true_peak_db for r in mt.true_peak(blocks_of(spark, waves, 1 << 20), "rec").collect()}
    assert abs(got["between"] - 20 * math.log10(0.5)) < 0.1 and abs(got["odd"] - 20 * math.log10(0.8)) < 0.1
    assert got["none"] == -200.0 and got["impulse"] == pytest.approx(0.0, abs=1e-6) and got["few"] >= 20 * math.log10(0.5) - 1e-6
    assert all(got[k] == pytest.approx(whole[k], abs=1e-9) for k in got)
    assert np.abs(waves["between"]).max() < 0.36


def test_retries_equal_a_plain_loop_and_never_end_silently(spark):
    rows = [(i, 0, s * 1_000_000) for i, s in enumerate([10, 29, 31, 64, 200, 977])]
    chunks = spark.createDataFrame(rows, "rec int, s_us long, e_us long")
    hard = lambda s, e: (s // 1000 + e // 7000) % 3 != 0
    tried = []

    def model(df):
        tried.append(df.count())
        bad = (F.floor(F.col("s_us") / 1000) + F.floor(F.col("e_us") / 7000)) % 3 != 0
        return df.withColumns({"text": F.concat(F.lit("t"), "s_us"), "error": F.when(bad, F.lit("CUDA out of memory"))})

    def plain(rec, s, e, attempt=0):
        if not hard(s, e):
            return [(rec, s, e, attempt, f"t{s}", False)]
        if e - s <= 30_000_000:
            return [(rec, s, e, attempt, "", True)]
        middle = s + (e - s) // 2 + 1000
        return plain(rec, s, middle, attempt + 1) + plain(rec, middle, e, attempt + 1)

    got = retries.retried_in_halves(chunks, ["rec"], model).collect()
    assert sorted(map(tuple, got)) == sorted(x for r in rows for x in plain(*r)) and len(tried) > 3
    with pytest.raises(RuntimeError, match="still fail"):
        retries.retried_in_halves(chunks, ["rec"], lambda df: df.withColumns({"text": F.lit(""), "error": F.lit("out of memory")}), floor_us=1, most_rounds=2)
    with pytest.raises(RuntimeError, match="no such file"):
        retries.retried_in_halves(chunks, ["rec"], lambda df: df.withColumns({"text": F.lit(""), "error": F.lit("no such file")}))
    assert retries.retried_in_halves(chunks.limit(0), ["rec"], model).count() == 0


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edits_equal_a_plain_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randrange(30))] for _ in range(2))
        assert cp.edits(a, b) == plain_edits(a, b)


def test_pairs_with_more_words_than_characters(spark):
    words = [f"w{i}" for i in range(60_000)]
    heard = [w for i, w in enumerate(words) if i % 7000 != 3] + ["tail"]
    heard[5000] = "changed"
    rows = spark.createDataFrame([(" ".join(words), " ".join(heard)), ("a b", "b"), ("", "x")], "r string, h string")
    assert [x.wer for x in cp.word_errors(rows, "r", "h").collect()] == [pytest.approx(11 / 60_000), 0.5, 1.0]


def test_turns_of_a_table_argument(spark):
    tf.install(spark)
    rows = [("a", 3, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 4, "y"), ("a", 6, "y"), ("a", 7, None), ("a", 8, "y"), ("b", 0, None), ("c", 5, "x")]
    spark.createDataFrame(rows, "rec string, frame long, who string").repartition(4).createOrReplaceTempView("frames_of_test")
    got = spark.sql("SELECT * FROM speaker_turns(TABLE(frames_of_test), 'rec', 'frame', 'who', 10)")
    assert got.schema.simpleString() == "struct<rec:string,turn:int,spk:string,s_us:bigint,e_us:bigint>"
    assert sorted(map(tuple, got.collect())) == [("a", 0, "x", 10, 40), ("a", 1, "y", 40, 50), ("a", 2, "y", 60, 70), ("a", 3, "y", 80, 90), ("c", 0, "x", 50, 60)]
    spark.sql("SELECT CAST(rec = 'a' AS INT) AS k, frame, frame AS who FROM frames_of_test").createOrReplaceTempView("frames_by_number")
    assert spark.sql("SELECT * FROM speaker_turns(TABLE(frames_by_number), 'k', 'frame', 'who', 10)").schema.simpleString() == "struct<k:int,turn:int,spk:bigint,s_us:bigint,e_us:bigint>"
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM speaker_turns(TABLE(frames_of_test), 'rec', 'nothing', 'who', 10)").collect()


def test_chunks_of_a_table_argument(spark):
    tf.install(spark)
    rows = [(1, 0, "abcd"), (1, 1, None), (1, 2, "efghij"), (1, 3, ""), (2, 0, "k")]
    spark.createDataFrame(rows, "rec int, n int, said string").createOrReplaceTempView("pieces_of_test")
    got = spark.sql("SELECT rec, chunk, n, text, fill FROM scored_chunks(TABLE(pieces_of_test), 'rec', 'n', 'said', 10)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 3, "abcd efghij", 1.0), (1, 1, 1, "", 0.0), (2, 0, 1, "k", 0.1)]


def test_retries_take_each_chunks_own_piece_and_join_no_text(spark, tmp_path, monkeypatch):
    from quillon.plans import model_queries as mq

    texts = ["ae\n𝄞é" * 100, "x" * 120, "b" * 121, "", None, "a" * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, own = [], retries.materialised
    monkeypatch.setattr(retries, "materialised", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    got = mq.int_retried(spark, str(tmp_path))
    assert len(plans) > 1 and not any("Join" in p for p in plans)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = c.execute(mq.ORACLE_SQL["int_retried"])
    assert sorted(tuple(r[x[0]] for x in cursor.description) for r in got.collect()) == sorted(cursor.fetchall())


def test_words_of_large_pairs_become_pythons_a_pair_at_a_time():
    assert cp._edits_of_many.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_blocks_of_recordings_are_numbered_over_ranges_and_export_sorts_no_samples(spark, tmp_path, monkeypatch):
    from quillon.operators import audio
    from quillon.plans import model_queries as mq

    monkeypatch.setattr(mq, "NUMBERED_IDS", 5)
    rows = [(i * 3 % 101, [float(i % 101)] * 64, i % 3) for i in range(101)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.label, r.block, r.first) for r in mq._recording_blocks(spark, str(tmp_path)).select("label", "block", F.get("samples", F.lit(0)).alias("first")).collect())
    want = []
    for label in range(3):
        want += [(label, n, r[1][0]) for n, r in enumerate(sorted(r for r in rows if r[2] == label))]
    assert got == want
    samples = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.25), (None, 0, 1.0)], "rec string, pos long, x double")
    same = audio.resampled(samples, "rec", 16, 16)
    assert sorted(tuple(r) for r in same.collect()) == [("a", 0, 0.5), ("a", 1, 0.25)]
    plan = same._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
