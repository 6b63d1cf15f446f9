"""Writers of the formats of a speech corpus, and the lines and names they use."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quillon.functions import text as tx


def transcript_line() -> Column:
    """Start, end, length (s), file and transcript, as a line of a comma table."""
    return F.concat_ws(",", tx.milli_seconds(F.col("s_us")), tx.milli_seconds(F.col("e_us")), tx.milli_seconds(F.col("e_us") - F.col("s_us")), tx.csv_field(F.col("filename"), ","), tx.csv_field(tx.one_line(F.col("transcript")), ","))


def transcript_block() -> Column:
    """The same row for readers."""
    return F.concat(F.lit("["), tx.clock(F.col("s_us")), F.lit(" --> "), tx.clock(F.col("e_us")), F.lit("] "), tx.one_line(F.col("transcript")))


def layout(base: Column, target: Column, accepted: Column, score: Column) -> Column:
    """Relative path of a slice: accepted ones by their name, rejected ones with their score."""
    return F.when(accepted, F.concat(F.lit("verified/"), tx.final_name(base, target), F.lit(".wav"))).otherwise(F.concat(F.lit("rejected/"), tx.final_name(base, target, F.round(score, 3)), F.lit(".wav")))


def reference_rows(segments: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Lines of a reference manifest: ``keys, nth, start_s, end_s, duration_s, filename``, numbered in the order of export.

    Planning writes these rows and no clips; exporting writes the clips under ``filename`` too.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = segments.withColumn("nth", nth)
    return rows.select(*keys, "nth", tx.milli_seconds(F.col("s_us")).alias("start_s"), tx.milli_seconds(F.col("e_us")).alias("end_s"), tx.milli_seconds(F.col("e_us") - F.col("s_us")).alias("duration_s"), tx.clip_file_name(F.col("nth"), F.col("s_us"), F.col("e_us")).alias("filename"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """A reference manifest with its header, in one file, as its reader wants it."""
    rows.orderBy("nth").select("start_s", "end_s", "duration_s", "filename").coalesce(1).write.mode("overwrite").csv(path, header=True)


def free_names(rows: DataFrame, folder: str, stem: str, order: str) -> DataFrame:
    """Adds ``name``: the stem, with ``_n`` from the second file of a stem in a folder on."""
    nth = F.row_number().over(Window.partitionBy(folder, stem).orderBy(order)) - 1
    return rows.withColumn("nth", nth).withColumn("name", F.when(F.col("nth") == 0, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("_"), F.col("nth").cast("string")))).drop("nth")


def clipboard_line() -> Column:
    """Id, text and file, parted by pipes."""
    return F.concat_ws("|", "clip_id", tx.one_line(F.col("transcript")), F.concat("clip_id", F.lit(".wav")))


def settings_line(names: list[str]) -> Column:
    """Settings as JSON in the given order."""
    return F.to_json(F.struct(*names))


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM; samples beyond [-1, 1] are cut."""
    data = np.round(np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def wav_column(rate: int):
    """A pandas UDF from samples to the bytes of a sound file."""
    @F.pandas_udf(BinaryType())
    def encode(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: None if s is None else wav_bytes(s, rate))

    return encode
