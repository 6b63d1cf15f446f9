"""Sound files in parts, by their headers alone, and written all or nothing."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import readers as rd
from quillon.sources import sound_files as sf
from quillon.sources.sinks import wav_bytes


def wave(n, seed=0):
    return np.round(np.random.default_rng(seed).uniform(-0.9, 0.9, n) * 32767) / 32767


def stereo(left, right, rate, extra=b""):
    data = np.stack([left, right], axis=1).astype("<i2").tobytes()
    chunk = b"LIST" + struct.pack("<I", len(extra)) + extra + b"\0" * (len(extra) & 1) if extra else b""
    return b"RIFF" + struct.pack("<I", 36 + len(chunk) + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * 4, 4, 16) + chunk + b"data" + struct.pack("<I", len(data)) + data


@pytest.fixture
def folder(spark, tmp_path):
    sf.install(spark)
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.wav").write_bytes(wav_bytes(wave(10_000), 8000))
    (tmp_path / "deep" / "b.WAV").write_bytes(stereo(np.arange(300), np.arange(300) * 3, 44_100, extra=b"x" * 100_001))
    (tmp_path / "none.wav").write_bytes(wav_bytes(np.zeros(0), 8000))
    (tmp_path / "torn.wav").write_bytes(wav_bytes(wave(50), 8000)[:100])
    (tmp_path / "junk.wav").write_bytes(b"not a sound file")
    (tmp_path / "notes.txt").write_bytes(b"RIFF")
    return str(tmp_path)


def test_headers_take_less_than_4_kb_a_file(spark, folder):
    got = {os.path.basename(r.path): r for r in spark.read.format("quillon_sound").option("read", "headers").load(folder).collect()}
    assert {k: (r.rate, r.channels, r.bits, r.frames, r.dur_us) for k, r in got.items()} == {
        "a.wav": (8000, 1, 16, 10_000, 1_250_000), "b.WAV": (44_100, 2, 16, 300, 300 * 1_000_000 // 44_100), "none.wav": (8000, 1, 16, 0, 0), "torn.wav": (8000, 1, 16, 28, 3500), "junk.wav": (None, None, None, 0, 0),
    }
    assert all(r.bytes_read < 4096 for r in got.values()) and os.path.getsize(f"{folder}/deep/b.WAV") > 100_000
    assert {os.path.basename(r.path): r.dur_us for r in rd.wav_durations(spark, f"{folder}/*.wav").collect()} == {k: r.dur_us for k, r in got.items() if k != "b.WAV"}


def test_a_long_file_is_several_partitions_that_read_their_own_bytes(spark, folder):
    df = spark.read.format("quillon_sound").option("block", "999").option("partbytes", "4000").load(f"{folder}/a.wav")
    assert df.rdd.getNumPartitions() == 6
    where = df.select(F.spark_partition_id().alias("p"), "block").collect()
    assert len({r.p for r in where}) == 6 and sorted(r.block for r in where) == list(range(11))
    got = df.orderBy("block").collect()
    assert np.allclose(np.concatenate([r.samples for r in got]), rd.wav_samples(open(f"{folder}/a.wav", "rb").read())[1]) and [r.begin for r in got] == [999 * i for i in range(11)]
    both = spark.read.format("quillon_sound").load(folder).filter("path like '%b.WAV' or path like '%junk%' or path like '%none%'").collect()
    assert sorted((os.path.basename(r.path), r.channels) for r in both) == [("b.WAV", 2), ("junk.wav", None)]


def frame(spark, names, bad=()):
    rows = [(n, 8000, None if n in bad else wave(20, i).tolist()) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, sf.WRITTEN).repartition(4, "name")


def names_read(spark, path):
    return sorted(os.path.basename(r.path) for r in spark.read.format("quillon_sound").load(path).collect())


def test_a_job_that_fails_leaves_no_file_and_the_old_manifest(spark, tmp_path):
    sf.install(spark)
    path = str(tmp_path / "out")
    frame(spark, ["a.wav", "b.wav"]).write.format("quillon_sound").mode("append").save(path)
    before, files = json.load(open(f"{path}/_current.json")), sorted(os.listdir(path))
    with pytest.raises(Exception, match="no sound file can be written"):
        frame(spark, [f"{i}.wav" for i in range(40)], bad=["33.wav"]).write.format("quillon_sound").mode("append").save(path)
    assert json.load(open(f"{path}/_current.json")) == before and sorted(os.listdir(path)) == files
    assert names_read(spark, path) == ["a.wav", "b.wav"]
    os.makedirs(f"{path}/job-died")
    open(f"{path}/job-died/x.wav", "wb").write(wav_bytes(wave(9), 8000))
    frame(spark, ["c.wav"]).write.format("quillon_sound").mode("append").save(path)
    assert names_read(spark, path) == ["a.wav", "b.wav", "c.wav"] and json.load(open(f"{path}/_current.json"))["files"] == 3
    frame(spark, ["d.wav"]).write.format("quillon_sound").mode("overwrite").save(path)
    assert names_read(spark, path) == ["d.wav"]
    with pytest.raises(Exception, match="need rate, samples"):
        spark.range(1).select(F.lit("x").alias("name")).write.format("quillon_sound").mode("append").save(path)


def test_short_files_share_partitions_and_are_each_read_once(spark, tmp_path, monkeypatch):
    sf.install(spark)
    path = str(tmp_path / "many")
    frame(spark, [f"{i:03}.wav" for i in range(300)]).coalesce(2).write.format("quillon_sound").mode("append").save(path)
    named = json.load(open(f"{path}/_current.json"))["folders"]
    assert sum(n for _, n, _ in named) == 300 and all(n == len(os.listdir(f"{path}/{f}")) and size == sum(os.path.getsize(f"{path}/{f}/{x}") for x in os.listdir(f"{path}/{f}")) for f, n, size in named)
    for folder, small in ((path, None), (f"{path}/{named[0][0]}", None), (path, "30")):
        reader = spark.read.format("quillon_sound").option("block", "7")
        df = (reader if small is None else reader.option("partbytes", small)).load(folder)
        assert df.rdd.getNumPartitions() <= sf.SMALL_PARTS
        got = df.select("path", "begin", F.size("samples").alias("n")).collect()
        assert len({(r.path, r.begin) for r in got}) == len(got) == 3 * (300 if folder == path else named[0][1]) and sum(r.n for r in got) == 20 * len(got) // 3
