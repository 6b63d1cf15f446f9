"""Structured Streaming forms of the operators that make sense on a stream.

`available` runs a streaming plan over what there is now and stops, so tests and
batch callers can compare it with its batch twin.  Checkpoints and results lie in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quillon.plans.shared import shared_path
from quillon.streaming.logs import BatchLog

LATE = "1 day"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a table's files, with the table's schema; the table may be a folder or one file.

    A stream takes its path for a folder unless it is a pattern.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def available(stream: DataFrame, mode: str = "append", at: tuple[str, str] | None = None) -> DataFrame:
    """Append everything the stream gives now to a table, once, and return the table.

    Run again with the same folders `at` (of the table and the state), it goes on with
    what has come since.
    """
    spark = stream.sparkSession
    out, state = at or (shared_path(spark, "streams"), shared_path(spark, "stream-state"))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Run `work` on every micro-batch that is available now."""
    state = shared_path(stream.sparkSession, "stream-state")
    stream.writeStream.foreachBatch(work).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def complete(stream: DataFrame) -> DataFrame:
    """A table of all rows of an aggregation over what the stream gives now, those of open windows too.

    Each batch has the whole result and is a table of its own; the one before it
    goes when it is finished.
    """
    spark = stream.sparkSession
    log = BatchLog(shared_path(spark, "streams"), stream.schema)

    def work(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)
        log.forget(batch.sparkSession, batch_id)

    each_batch(stream, work, "complete")
    return log.newest(spark)


#: Batches of an update log before it is compacted.
COMPACT_EVERY = 16


def latest(stream: DataFrame, keys: list[str], version: str) -> DataFrame:
    """A table of the last version of each key of an updating aggregation.

    Each batch writes its changed rows; the row with the greatest `version` (a count
    that only grows) counts, so a batch that runs twice does no harm.  The log is
    compacted to the last versions again and again, so it follows the keys and not
    the batches.
    """
    spark = stream.sparkSession
    log = BatchLog(shared_path(spark, "streams"), stream.schema)

    def work(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            log.compact(batch.sparkSession, keys, version)

    each_batch(stream, work)
    return log.last(spark, keys, version)


def once(events: DataFrame, keys: list[str], delay: str = LATE) -> DataFrame:
    """Events without repeats of `keys` that come within `delay` of each other; state is kept for so long only."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def closed_sessions(turns: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Sessions that the watermark has passed: ``keys, s_us, e_us, n``; their state is dropped.

    ``turns`` has ``ts`` (with a watermark), ``s_us`` and ``e_us``.
    """
    gap = F.concat((F.col("e_us") - F.col("s_us") + gap_us + 1).cast("string"), F.lit(" microseconds"))
    own = turns.filter("e_us > s_us").groupBy(*keys, F.session_window("ts", gap))
    return own.agg(F.min("s_us").alias("s_us"), F.max("e_us").alias("e_us"), F.count("*").alias("n")).drop("session_window")


def session_job(source: str, schema: StructType, log: BatchLog, state: str, keys: list[str], gap_us: int, ids: list[str], delay: str = LATE, most_batches: int | None = None, files_each: int | None = 1) -> None:
    """Work off the files that are there now: events once each, closed sessions to a log, `files_each` files a batch (None: all that are there).

    ``source`` holds files of ``ts, s_us, e_us`` with the keys and ids.  Run again on
    the same `state` it goes on where it stopped, in the middle of a session too.
    With `most_batches` it ends after so many (what a crash leaves).
    """
    spark = SparkSession.active()
    reader = spark.readStream.schema(schema)
    events = (reader if files_each is None else reader.option("maxFilesPerTrigger", files_each)).parquet(source)
    found = closed_sessions(once(events, ids, delay), keys, gap_us)
    done = 0

    def work(batch: DataFrame, batch_id: int) -> None:
        nonlocal done
        log.write(batch, batch_id)
        done += 1
        if most_batches is not None and done >= most_batches:
            raise RuntimeError("stopped")

    query = found.writeStream.foreachBatch(work).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if most_batches is None or done < most_batches:
            raise


def flush(source: str, schema: StructType, keys: dict[str, object]) -> None:
    """A last event (of no length, far ahead) that lets the watermark pass all open sessions in the next run."""
    spark = SparkSession.active()
    far = datetime(2200, 1, 1)
    one = {"ts": far, "s_us": 0, "e_us": 0} | keys
    spark.createDataFrame([tuple(one.get(f.name) for f in schema)], schema).coalesce(1).write.mode("append").parquet(source)


def exits_held(wait_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """State of a run: how many lines have been, and the exits that wait for more, with how many each expects."""

    def given(key: tuple, lines: list[int], ends: bool, after: list[int], complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]] * len(lines), "line": lines, "ends": ends, "after": after, "complete": complete})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held, expected = state.get if state.exists else (0, [], [])
        waiting = list(zip(held, expected, strict=True))
        if state.hasTimedOut:  # the watermark has passed
            yield given(key, sorted(x for x, _ in waiting), True, [seen] * len(waiting), False)
            state.update((seen, [], []))
            return
        newest = 0
        for batch in batches:
            is_line = batch["expected"].isna()
            newest = max(newest, int(batch["ts"].max().timestamp() * 1000))
            lines = batch.loc[is_line, "line"].tolist()
            waiting += [(int(a), int(b)) for a, b in zip(batch.loc[~is_line, "line"], batch.loc[~is_line, "expected"], strict=True)]
            if lines:
                yield given(key, lines, False, list(range(seen, seen + len(lines))), True)
                seen += len(lines)
        ready = sorted(x for x, n in waiting if n <= seen)
        if ready:
            yield given(key, ready, True, [seen] * len(ready), True)
        left = [x for x in waiting if x[1] > seen]
        state.update((seen, [x for x, _ in left], [n for _, n in left]))
        if left:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + wait_ms)

    return run


def lines_then_exit(events: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """Lines of a run are given out as they come; its exits wait until as many lines as they expect have been.

    ``events`` is a stream of ``ts`` (when the line was logged, with a watermark),
    ``run, line, expected`` (null but for exits).  Gives ``run, line, ends, after,
    complete``: ``after`` counts the lines that went before.  An exit whose run is
    silent until the watermark is `wait_ms` past it is given out with ``complete`` false.
    """
    kind = events.schema["run"].dataType.simpleString()
    out = f"run {kind}, line long, ends boolean, after long, complete boolean"
    return events.groupBy("run").applyInPandasWithState(exits_held(wait_ms), out, "seen long, held array<long>, expected array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, seconds: int, keys: list[str]) -> DataFrame:
    """Counts and sums of ``value`` in tumbling windows of ``ts``; rows later than a day are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    found = timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *keys).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return found.select(*keys, F.unix_seconds("w.start").alias("starts"), "n", "last_id")


def sliding(events: DataFrame, seconds: int, every: int, keys: list[str]) -> DataFrame:
    """Counts in windows of `seconds` that begin every so many seconds of ``ts``: ``keys, starts, n, last_id``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    found = timed.groupBy(F.window("ts", f"{seconds} seconds", f"{every} seconds").alias("w"), *keys).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return found.select(*keys, F.unix_seconds("w.start").alias("starts"), "n", "last_id")


def joined_text(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Texts of each key joined in order, with blank ones left out; works on streams too."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.filter(F.trim(text) != "").groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias(text))


def rank_stages(key: str, stage: str) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """State of a run: the greatest stage reached; earlier stages count as done."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached, seen = state.get if state.exists else (-1, 0)
        for rows in batches:
            reached, seen = max(reached, int(rows[stage].max())), seen + len(rows)
        state.update((reached, seen))
        yield pd.DataFrame({key: [k[0]], "reached": [reached], "n": [seen]})

    return run


def stage_state(events: DataFrame, key: str, stage: str) -> DataFrame:
    """``key, reached, n`` after every batch: a monotone state for each run."""
    kind = events.schema[key].dataType.simpleString()
    return events.select(key, stage).groupBy(key).applyInPandasWithState(rank_stages(key, stage), f"{key} {kind}, reached long, n long", "reached long, n long", "update", GroupStateTimeout.NoTimeout)


def skip_done(stream: DataFrame, manifest_path: str, key: str) -> None:
    """Work off new inputs only: a batch's rows without those in the manifest are appended to it."""
    schema = StructType([stream.schema[key]])

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key).distinct()
        try:
            done = spark.read.schema(schema).parquet(manifest_path)
            new = new.join(done, key, "left_anti")
        except Exception as e:  # the first batch finds no manifest
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(manifest_path)

    each_batch(stream, work)
