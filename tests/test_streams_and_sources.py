"""Streams against their batch twins; readers, rules and the registry."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon.functions import registry as rg
from quillon.functions import rules as ru
from quillon.operators import intervals as iv
from quillon.operators import mining as mi
from quillon.plans import dataset as ds
from quillon.sources import readers as rd

SF = "/root/testdata/sf0.001"


def test_streams_equal_their_batch_form(spark):
    users = spark.read.parquet(f"{SF}/events.parquet")
    got = catalog.QUERIES["stm_stage_state"](spark, SF).collect()
    want = users.groupBy("user_id").agg(F.max(F.col("event_id") % 7).alias("reached"), F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    seen = catalog.QUERIES["stm_incremental"](spark, SF)
    assert seen.count() == seen.distinct().count() == users.select("user_id").distinct().count()


def test_stream_sessions_equal_batch_sessions(spark, tmp_path):
    twice = spark.read.parquet(f"{SF}/events.parquet")
    spans = lambda rows: rows.select(F.col("event_type").alias("spk"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s_us"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e6).cast("long")).alias("e_us"))
    want = lambda rows: sorted(map(tuple, iv.union(spans(rows), ["spk"], iv.GAP_US).select("spk", "s_us", "e_us").collect()))
    got = lambda d: sorted((r.spk, r.s_us, r.e_us) for r in catalog.QUERIES["stm_session_union"](spark, d).collect())
    assert got(SF) == want(twice)
    # all events within a day, and a file with older rows after newer ones
    day = twice.filter(F.col("ts") < twice.agg(F.min("ts")).first()[0] + F.expr("INTERVAL 20 HOURS"))
    (tmp_path / "day").mkdir()
    day.orderBy(F.desc("ts")).coalesce(1).write.parquet(f"{tmp_path}/day/events.parquet")
    assert got(f"{tmp_path}/day") == want(day) != []


def wav(samples, channels=1, rate=8000):
    data = np.asarray(samples, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def test_wav_files_become_blocks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([0, 16384, -16384, 0] * 4000, channels=2))
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxx")
    blocks = rd.wav_blocks(spark, f"file://{tmp_path}", seconds=1).orderBy("path", "block").collect()
    assert [(r.rate, r.block, len(r.samples) if r.samples else None) for r in blocks] == [(8000, 0, 8000), (None, None, None)]
    assert blocks[0].samples[:2] == [0.25, -0.25]
    lengths = {r.path[-5:]: r.dur_us for r in rd.wav_durations(spark, f"file://{tmp_path}").collect()}
    assert lengths == {"a.wav": 1_000_000, "n.wav": 0}


def test_text_readers(spark, tmp_path):
    lines = spark.createDataFrame([(1, "bad\n0 1 s0\n5 5 s0\n 1.5\t2  s1 "), (2, None)], "k int, text string")
    assert [(r.track, r.spk, r.s_us, r.e_us) for r in rd.turn_lines(lines, "k", "text").orderBy("track").collect()] == [(1, "s0", 0, 1_000_000), (3, "s1", 1_500_000, 2_000_000)]
    log = spark.createDataFrame([(1, "silence_start: 2\nx silence_end: 3 | d\nsilence_start: 8")], "k int, text string")
    assert [(r.s_us, r.e_us) for r in mi.silence_rows(log, "k", "text").orderBy("s_us").collect()] == [(2_000_000, 3_000_000), (8_000_000, None)]
    assert spark.range(1).select(mi.duration_us(F.lit("  Duration: 01:02:03.50, start")), mi.duration_us(F.lit("n/a"))).first() == (3_723_500_000, None)
    (tmp_path / "t.csv").write_text('original_start_s,filename,transcript\n1,a.wav,"x, y"\n2,a.wav,z\n3,b.wav,q\n')
    assert {tuple(r) for r in rd.transcripts(spark, str(tmp_path / "t.csv")).collect()} == {("a.wav", "z"), ("b.wav", "q")}
    (tmp_path / "log.jsonl").write_text('{"path":"a","text":"1"}\n{"path":"a","text":"2"}\n{"path":"b"}\n{"path":"c","te')
    assert {tuple(r) for r in rd.results_log(spark, str(tmp_path / "log.jsonl")).collect()} == {("a", "2"), ("b", "")}


def test_rules(spark):
    rows = spark.createDataFrame([(["a_(Vocals).wav", "b_vocal.wav"], "oom", -60.0, -60.0), (["x_vocal.wav"], "0", -20.0, -50.0), (["n.wav"], "30", -20.0, -20.0)], "stems array<string>, t string, v double, b double")
    got = rows.select(ru.vocal_stem(F.col("stems")).alias("s"), ru.timeout_seconds(F.col("t")).alias("t"), ru.clean_verdict(F.col("v"), F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("a_(Vocals).wav", 1800.0, "kept_original"), ("x_vocal.wav", None, "already_clean"), (None, 30.0, "cleaned")]


def test_registry_names_what_there_is():
    with pytest.raises(ValueError, match="unknown family"):
        rg.register("nothing", "x", dict)
    with pytest.raises(KeyError, match="cosine"):
        rg.create("scorer", "missing")
    with pytest.raises(RuntimeError, match="not available"):
        rg.create("diarizer", "external")


def test_split_covers_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i:03d}", f"t|{i}", "n") for i in range(50)], "clip_id string, transcript string, normalized string")
    for split in (ds.split_by_hash, ds.split_seeded):
        held = [r.clip_id for r in split(rows, 0.1).filter("is_eval").orderBy("clip_id").collect()]
        assert len(held) == 5 and held == [r.clip_id for r in split(rows.repartition(7), 0.1).filter("is_eval").orderBy("clip_id").collect()]
    order = np.arange(50)
    np.random.default_rng(1234).shuffle(order)
    assert held == sorted(f"c{i:03d}" for i in order[:5])
    ds.write_lines(rows.select("clip_id", ds.csv_line().alias("value")), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines()[0] == 'c000|"t|0"|n' and len(text.splitlines()) == 50


def test_seeded_split_has_no_bound_and_ranks_in_ranges(spark):
    n = 2_000_300
    rows = spark.range(n, numPartitions=4).select(F.format_string("c%08d", (F.col("id") * 7919) % n).alias("clip_id"))
    order = np.arange(n)
    np.random.default_rng(1234).shuffle(order)
    split = ds.split_seeded(rows, 0.1)
    assert split.count() == n
    assert [r.rank for r in split.filter("is_eval").select(F.substring("clip_id", 2, 8).cast("long").alias("rank")).orderBy("rank").collect()] == sorted(order[: round(n * 0.1)].tolist())
    assert "SinglePartition" not in "".join(x for x in ds.ranked(rows)._jdf.queryExecution().executedPlan().toString().splitlines(True) if "clip_id" in x)
    assert ds.split_seeded(rows.limit(0), 0.1).count() == 0


def test_regions_of_the_segmenter_are_bounded(spark, tmp_path):
    from quillon.plans import corpus_queries as cq

    one = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("label", F.lit(3).cast("int"))
    one = one.union(one.withColumn("vec_id", F.col("vec_id") + 1000)).union(one.withColumn("vec_id", F.col("vec_id") + 2000))
    one.write.parquet(f"{tmp_path}/embeddings.parquet")
    n = one.count()
    sizes = [r["count"] for r in cq._track(spark, str(tmp_path)).groupBy("region").count().collect()]
    assert sum(sizes) == 8 * n and max(sizes) <= 8 * cq.REGION_IDS < 8 * n
    clips = cq.seg_walk(spark, str(tmp_path)).groupBy("label", "block").agg(F.min("first").alias("a"), F.max("past").alias("b")).collect()
    assert {r.label for r in clips} == {3} and len(clips) == len(sizes)


def test_readers_start_afresh_and_follow_the_files(spark, tmp_path):
    gone = str(tmp_path / "none")
    assert rd.transcripts(spark, gone).collect() == [] and rd.completed(spark, gone).collect() == []
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.csv").write_text("a,b,c,d,e\n1,2,3,x.wav,one\n1,2,3\n1,2,3,y.wav,two\n" + "".join(f"1,2,3,z{i}.wav,t\n" for i in range(2000)))
    (tmp_path / "t" / "2.csv").write_text("a,b,c,d,e\n1,2,3,x.wav,later\n")
    got = {r.filename: r.transcript for r in rd.transcripts(spark, str(tmp_path / "t")).collect()}
    assert got["x.wav"] == "later" and got["y.wav"] == "two" and len(got) == 2002
    (tmp_path / "n.csv").write_text("Transcript ,x, FileName\nhello,1,a.wav\n")
    assert [tuple(r) for r in rd.transcripts(spark, str(tmp_path / "n.csv")).collect()] == [("a.wav", "hello")]
    (tmp_path / "short.csv").write_text("p,q\n1,2\n")
    assert rd.transcripts(spark, str(tmp_path / "short.csv")).collect() == []
    (tmp_path / "done.json").write_text('{"k1": "done", "k2": "failed"}')
    assert {tuple(r) for r in rd.completed(spark, str(tmp_path / "done.json")).collect()} == {("k1", "done"), ("k2", "failed")}
    (tmp_path / "torn.json").write_text('{"k1": "do')
    assert rd.completed(spark, str(tmp_path / "torn.json")).collect() == []


def test_candidates_need_their_clip(spark, tmp_path):
    from quillon.sources import sinks as si

    segments = spark.createDataFrame([("r", 3_200_000, 7_849_999), ("r", 0, 1_500_000), ("r", 9_000_000, 9_900_000)], "rec string, s_us long, e_us long")
    rows = si.reference_rows(segments, ["rec"], ["s_us"])
    si.write_manifest(rows, str(tmp_path / "m"))
    names = [r.filename for r in rows.orderBy("nth").collect()]
    assert names == ["ref_000_0.0s-1.5s.wav", "ref_001_3.2s-7.8s.wav", "ref_002_9.0s-9.9s.wav"]
    (tmp_path / "w").mkdir()
    for n in names[:2]:
        (tmp_path / "w" / n).write_bytes(b"x")
    listed = rd.files_below(spark, str(tmp_path / "w"))
    assert listed.filter("modified_ms > 0 and length = 1").count() == 2
    got = rd.candidates(spark, str(tmp_path / "m"), listed.select(F.substring_index("path", "/", -1).alias("name")))
    assert {(r.name, r.s_us, r.dur_us) for r in got.collect()} == {(names[0], 0, 1_500_000), (names[1], 3_200_000, 4_650_000)}


def test_unknown_settings_can_stay(spark):
    rows = spark.createDataFrame([('{"a":"1","zz":"2"}',), ("junk",)], "t string")
    got = rd.settings(rows, "t", {"a": "0"}, keep="rest").collect()
    assert [(r.a, r.rest) for r in got] == [("1", {"zz": "2"}), ("0", None)]


def test_session_stream_equals_its_batch_twin(spark):
    from quillon.operators import intervals as iv
    from quillon.plans import stream_queries as sq

    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("spk"), ts.alias("s_us"), (ts + F.round(F.col("value") * 1e6).cast("long")).alias("e_us"))
    batch = iv.session_union(rows, ["spk"], iv.GAP_US)
    assert sorted(map(str, sq.stm_session_union(spark, SF).collect())) == sorted(map(str, batch.collect()))


def test_stages_need_their_settings():
    stage = rg.Stage("x", lambda rows, _: rows, needs=("a", "b"))
    with pytest.raises(KeyError, match="needs b"):
        rg.run_stages(None, [stage], {"a": 1})
    assert rg.run_stages("rows", [rg.Stage("off", lambda rows, _: None, on=lambda given: False)], {}) == "rows"
