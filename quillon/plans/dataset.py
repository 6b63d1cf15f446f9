"""Dataset export: accepted clips as sorted lines, with a repeatable evaluation split."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.gate import normalized
from quillon.plans.shared import materialised


def rows(judged: DataFrame, in_order: bool = False) -> DataFrame:
    """``clip_id, transcript, normalized, speaker, language, dur_us`` of accepted clips, on one line each; by id if asked.

    Clips are sorted before their texts are normalised: sorting draws a sample,
    which would else normalise them twice.
    """
    kept = judged.filter("accepted").select("clip_id", "transcript", "speaker", "language", "dur_us")
    kept = kept.orderBy("clip_id") if in_order else kept
    return kept.select("clip_id", tx.one_line(F.col("transcript")).alias("transcript"), normalized(F.col("transcript"), F.col("language")).alias("normalized"), "speaker", "language", "dur_us")


def csv_line() -> Column:
    """A manifest line: three fields, pipes between, quoted only where needed."""
    return F.concat_ws("|", *[tx.csv_field(F.col(c)) for c in ("clip_id", "transcript", "normalized")])


def _json(value: Column) -> Column:
    """A value as JSON: null, a number, or a quoted string."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_line() -> Column:
    """A manifest line as JSON, with a space after each comma and colon; nulls are written."""
    fields = {
        "audio_filepath": F.concat(F.lit("wavs/"), F.col("speaker"), F.lit("/"), F.col("clip_id"), F.lit(".wav")),
        "text": F.col("transcript"),
        "normalized_text": F.col("normalized"),
        "speaker": F.col("speaker"),
        "language": F.col("language"),
        "duration": F.round(F.col("dur_us") / 1_000_000, 4),
    }
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), _json(v)) for k, v in fields.items()]), F.lit("}"))


def split_by_hash(dataset: DataFrame, fraction: float, seed: int = 1234) -> DataFrame:
    """Adds ``is_eval``: the share of clips with the least hash of id and seed.

    The k-th least hash is found by ranks inside 4096 hash ranges and a running
    count over them, so no sort of all clips runs in one task.
    """
    digest = F.sha1(F.concat("clip_id", F.lit(str(seed))).cast("binary"))
    hashed = dataset.withColumn("digest", digest).withColumn("part", F.left("digest", F.lit(3)))
    counts = hashed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.bround(F.sum("n").over(every) * fraction, 0).alias("n_eval"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("digest", "clip_id"))
    # at most 4096 ranges
    return hashed.withColumn("rank", rank).join(F.broadcast(starts), "part").withColumn("is_eval", F.col("first") + F.col("rank") <= F.col("n_eval")).select(*dataset.columns, "is_eval")


#: Ranks in one row of the picked ones.
BLOCK = 1 << 16


def ranked(dataset: DataFrame) -> DataFrame:
    """Adds ``rank``, the place in the order of ``clip_id`` from 0 on.

    Ids are dealt into ranges, ranked inside each, and moved by the counts of the
    ranges before, so no task sees all of them.
    """
    n = max(8, int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges are drawn from a sample, so they are written once and read by both uses
    parts = materialised(dataset.repartitionByRange(n, "clip_id").withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("clip_id")) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("inside")).select(*dataset.columns, "rank")


def split_seeded(dataset: DataFrame, fraction: float, seed: int = 1234) -> DataFrame:
    """Adds ``is_eval`` by a seeded permutation of the sorted ids.

    The permutation is numpy's, which has to be drawn in one sequence: the driver
    holds four bytes for each clip, and the picked ranks go out as one bit each.
    """
    import numpy as np

    rows = ranked(dataset)
    n = rows.count()
    order = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    np.random.default_rng(seed).shuffle(order)
    picked = np.zeros(-(-n // BLOCK) * BLOCK, bool)
    picked[order[: int(round(n * fraction))]] = True
    del order
    bits = np.packbits(picked.reshape(-1, BLOCK), axis=1)
    blocks = dataset.sparkSession.createDataFrame(pa.table({"block": pa.array(range(len(bits)), pa.int64()), "bits": pa.array([b.tobytes() for b in bits], pa.binary())}))
    at = F.col("rank") % BLOCK
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_eval = F.getbit(byte, (7 - at % 8).cast("int")) == 1
    return rows.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(blocks, "block").select(*dataset.columns, is_eval.alias("is_eval"))


def summary(gated: DataFrame, split: DataFrame) -> DataFrame:
    """One row: candidates, rejected, clips, train and evaluation clips."""
    judged = gated.agg(F.count("*").alias("n_candidates"), F.count_if(~F.col("accepted")).alias("n_rejected"))
    parts = split.agg(F.count("*").alias("n_clips"), F.count_if(~F.col("is_eval")).alias("n_train"), F.count_if("is_eval").alias("n_eval"))
    return judged.crossJoin(parts)


def write_lines(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """Sorted text lines; ``lines`` has ``clip_id`` and ``value``.

    Files follow one another by name, each a range of ids.  `one_file` gives a
    trainer that reads a single file just that; then one task writes it.
    """
    ordered = lines.orderBy("clip_id").select("value")
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").text(path)
