"""Readers of the formats of a speech corpus."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def _riff(data: bytes) -> tuple[int, int, int, int, int] | None:
    """(channels, rate, bits, offset, bytes) of 16-bit or 8-bit PCM in a RIFF file; None if it is something else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            form = (channels, rate, bits) if kind == 1 and bits in (8, 16) and channels and rate else None
        elif name == b"data":
            return (*form, at + 8, min(size, len(data) - at - 8)) if form else None
        at += 8 + size + (size & 1)
    return None


def wav_samples(data: bytes) -> tuple[int, np.ndarray] | None:
    """Rate and mono samples in [-1, 1]; channels are averaged; None if the file cannot be read."""
    found = _riff(data)
    if found is None:
        return None
    channels, rate, bits, at, size = found
    raw = np.frombuffer(data, np.uint8 if bits == 8 else "<i2", size * 8 // bits // channels * channels, at)
    wave = (raw.astype(np.float32) - 128) / 128 if bits == 8 else raw.astype(np.float32) / 32768
    return rate, wave.reshape(-1, channels).mean(axis=1)


BLOCKS = "path string, rate int, block int, samples array<float>"


def wav_blocks(spark: SparkSession, path: str, seconds: int = 10) -> DataFrame:
    """Recordings as blocks of samples: ``path, rate, block, samples``; a file that cannot be read has one row of nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                read = wav_samples(bytes(content))
                if read is None:
                    yield pd.DataFrame({"path": [name], "rate": [None], "block": [None], "samples": [None]})
                    continue
                rate, wave = read
                step = rate * seconds
                for i in range(0, max(1, len(wave)), step):
                    yield pd.DataFrame({"path": [name], "rate": [rate], "block": [i // step], "samples": [wave[i : i + step]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, BLOCKS)


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """``path, dur_us`` from headers; 0 if there is none to read."""

    @F.pandas_udf("long")
    def duration(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> int:
            found = _riff(data)
            return 0 if found is None else found[4] * 8 // found[2] // found[0] * 1_000_000 // found[1]

        return content.map(lambda c: one(bytes(c)))

    return spark.read.format("binaryFile").load(path).select("path", duration("content").alias("dur_us"))


def turn_lines(lines: DataFrame, key: str, text: str) -> DataFrame:
    """``key, track, spk, s_us, e_us`` from lines ``start end speaker``; short lines and empty turns are dropped."""
    rows = lines.select(key, F.posexplode(F.split(text, "\n")).alias("track", "line")).withColumn("p", F.filter(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), lambda x: x != ""))
    us = lambda i: (F.col("p")[i].try_cast("decimal(18,6)") * 1_000_000).cast("long")
    return rows.filter(F.size("p") >= 3).select(key, "track", F.col("p")[2].alias("spk"), us(0).alias("s_us"), us(1).alias("e_us")).filter("e_us > s_us")


def turn_structs(rows: DataFrame, key: str, turns: str) -> DataFrame:
    """The same from an array of structs ``start, end, speaker`` (seconds); nested arrays, one a channel, are laid end to end."""
    kind = rows.schema[turns].dataType.elementType
    flat = F.flatten(turns) if isinstance(kind, ArrayType) else F.col(turns)
    us = lambda c: (F.col(f"t.{c}").cast("decimal(18,6)") * 1_000_000).cast("long")
    found = rows.select(key, F.posexplode(flat).alias("track", "t")).select(key, "track", F.col("t.speaker").cast("string").alias("spk"), us("start").alias("s_us"), us("end").alias("e_us"))
    return found.filter("e_us > s_us")


def _or_empty(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """What `read` gives; an empty table if its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _in_file_order(rows: DataFrame) -> DataFrame:
    """Adds ``nth``, which sorts rows as their files have them: by file, block and row."""
    return rows.withColumn("nth", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``filename, transcript`` of a transcript table with a header.

    Columns are found by name, whatever their case, else they are the fourth and
    the fifth.  Rows too short for both are dropped, the last row of a file name
    counts, and a path that does not exist gives an empty table.
    """
    kind = "filename string, transcript string"

    def read() -> DataFrame:
        rows = _in_file_order(spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\u0000", emptyValue=""))
        names = [c.strip().lower() for c in rows.columns[:-1]]
        at = [names.index(n) if n in names else i for n, i in (("filename", 3), ("transcript", 4))]
        if max(at) >= len(names):
            return spark.createDataFrame([], kind)
        rows = rows.toDF(*[f"c{i}" for i in range(len(names))], "nth").select(F.col(f"c{at[0]}").alias("filename"), F.col(f"c{at[1]}").alias("transcript"), "nth")
        return rows.dropna(subset=["filename", "transcript"]).groupBy("filename").agg(F.max_by("transcript", "nth").alias("transcript"))

    return _or_empty(read, spark, kind)


def results_log(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of a log of JSON lines; torn lines are dropped, the last line of a path counts."""
    rows = _in_file_order(spark.read.schema("path string, text string").option("mode", "DROPMALFORMED").json(path))
    return rows.filter("path is not null").groupBy("path").agg(F.max_by(F.coalesce("text", F.lit("")), "nth").alias("text"))


def candidate_rows(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates from the first four fields of manifest lines (``c0`` to ``c3``): ``keys, name, s_us, dur_us``.

    Lines with fewer fields, or without numbers as start and length, are dropped.
    """
    us = lambda c: F.round(F.col(c).try_cast("double") * 1_000_000).cast("long")
    rows = fields.select(*keys, F.trim("c3").alias("name"), us("c0").alias("s_us"), us("c2").alias("dur_us"))
    return rows.dropna(subset=["name", "s_us", "dur_us"])


def candidates(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Candidates of reference manifests, those whose clip is in the listing (``name``)."""
    fields = spark.read.schema("c0 string, c1 string, c2 string, c3 string").csv(path, header=True, quote="")
    return candidate_rows(fields, []).join(files.select("name"), "name", "left_semi")


def metadata_rows(lines: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys, id, text`` of metadata lines ``id|text|...``; lines without two fields or with a blank id are dropped."""
    parts = F.split(value, "[|]", 3)
    return lines.select(*keys, parts.alias("p")).filter((F.size("p") >= 2) & (F.trim(F.col("p")[0]) != "")).select(*keys, F.col("p")[0].alias("id"), F.trim(F.col("p")[1]).alias("text"))


def completed(spark: SparkSession, path: str) -> DataFrame:
    """``job_key, status`` of a manifest in JSON; one that is torn or is not there starts afresh, as an empty table."""

    def read() -> DataFrame:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("job_key", "status"))

    return _or_empty(read, spark, "job_key string, status string")


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """A listing: ``path, modified_us, modified_ms, length`` of all files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.unix_micros("modificationTime").alias("modified_us"), F.unix_millis("modificationTime").alias("modified_ms"), "length")


def settings(rows: DataFrame, text: str, defaults: dict[str, str], keep: str | None = None) -> DataFrame:
    """JSON settings over defaults: junk gives the defaults; unknown keys go, or stay together as a map named `keep`."""
    if keep:
        known = F.array(*[F.lit(k) for k in defaults])
        rows = rows.withColumn(keep, F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: ~F.array_contains(known, k)))
    kinds = ", ".join(f"`{k}` string" for k in defaults)
    given = F.from_json(text, kinds)
    return rows.select("*", *[F.coalesce(given[k], F.lit(v)).alias(k) for k, v in defaults.items()])
