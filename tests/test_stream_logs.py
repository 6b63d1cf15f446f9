"""Streams that die and go on, exits that wait, logs that are compacted."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.operators import intervals as iv
from quillon.streaming import jobs as st
from quillon.streaming.logs import BatchLog

START = datetime(2024, 1, 1)


def lines(spark, path, schema, rows, minute):
    spark.createDataFrame([(*r, START + timedelta(minutes=minute)) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


def test_exits_wait_for_their_lines_or_for_the_timer(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "run int, line long, expected long, ts timestamp"
    lines(spark, path, schema, [(1, 100, 3), (2, 200, 1), (3, 300, 2), (1, 1, None)], 0)
    lines(spark, path, schema, [(1, 2, None), (2, 5, None), (3, 6, None)], 1)
    lines(spark, path, schema, [(1, 3, None), (1, 4, None)], 2)
    lines(spark, path, schema, [(9, 9, None)], 600)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "10 minutes")
    got = st.available(st.lines_then_exit(stream, wait_ms=3_600_000)).collect()
    assert sorted((r.run, r.line) for r in got if not r.ends) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (3, 6), (9, 9)]
    assert sorted((r.run, r.line, r.after, r.complete) for r in got if r.ends) == [(1, 100, 4, True), (2, 200, 1, True), (3, 300, 1, False)]
    for run in (1, 2):
        own = [r for r in got if r.run == run and not r.ends]
        assert sorted(r.after for r in own) == list(range(len(own)))


def test_sessions_survive_a_crash_in_the_middle_and_repeats(spark, tmp_path):
    ddl = "spk string, id long, ts timestamp, s_us long, e_us long"
    schema, source = StructType.fromDDL(ddl), str(tmp_path / "in")
    rows = [("x", i, START + timedelta(seconds=10 * i), 10_000_000 * i, 10_000_000 * i + (9_800_000 if i % 5 else 2_000_000)) for i in range(40)] + [("y", 100, START, 0, 400_000_000)]
    rows.sort(key=lambda r: r[2])
    for part in (rows[:15], rows[10:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    log = BatchLog(str(tmp_path / "out"), StructType.fromDDL("spk string, s_us long, e_us long, n long"))
    job = lambda most=None: st.session_job(source, schema, log, str(tmp_path / "state"), ["spk"], 250_000, ["id"], delay="1 minute", most_batches=most)
    job(1)
    early = log.rows(spark).count()
    job(1)
    job()
    assert early <= log.rows(spark).count() < 9
    st.flush(source, schema, {"spk": "", "id": -1})
    job()
    job()
    batch = iv.union(spark.createDataFrame(rows, schema), ["spk"], 250_000).collect()
    assert sorted(map(tuple, log.rows(spark).collect())) == sorted((r.spk, r.s_us, r.e_us, r.n) for r in batch)


def test_a_log_is_compacted_and_unfinished_batches_are_not_seen(spark, tmp_path):
    log = BatchLog(str(tmp_path / "log"), StructType.fromDDL("k string, n long, v string"))
    assert log.rows(spark).count() == 0
    frame = lambda *rows: spark.createDataFrame(rows, log.schema)
    log.write(frame(("a", 1, "one"), ("b", 1, "one")), 0)
    log.write(frame(("a", 2, "two")), 1)
    log.write(frame(("a", 2, "two")), 1)
    assert log.rows(spark).count() == 3
    log.compact(spark, ["k"], "n")
    assert log.finished(spark, "batch") == [] and log.finished(spark, "base") == [1] and log.rows(spark).count() == 2
    log.write(frame(("b", 5, "five")), 2)
    (tmp_path / "log" / "batch=3").mkdir()
    want = [("a", 2, "two"), ("b", 5, "five")]
    assert sorted(map(tuple, log.last(spark, ["k"], "n").collect())) == want
    log.compact(spark, ["k"], "n")
    assert sorted(map(tuple, log.rows(spark).collect())) == want and log.finished(spark, "base") == [2]


def test_an_update_log_follows_its_keys_not_its_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "COMPACT_EVERY", 2)
    path = str(tmp_path / "in")
    for i in range(5):
        spark.range(i + 1).select((F.col("id") % 2).alias("k")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(path)
    got = st.latest(stream.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n").collect()
    assert sorted(map(tuple, got)) == [(0, 9), (1, 6)]


def test_a_stream_goes_on_from_its_state_with_what_has_come_since(spark, tmp_path):
    """The lines and exits of a run, logged in two parts of several files each, which are a batch each."""
    path, at = str(tmp_path / "log"), (str(tmp_path / "out"), str(tmp_path / "state"))
    logged = lambda rows, minute: spark.createDataFrame([(datetime(2024, 1, 1, 0, minute), *r) for r in rows], "ts timestamp, run string, line long, expected long").repartition(3, "line").write.mode("append").parquet(path)
    logged([("a", 100, 5), ("a", 0, None), ("a", 1, None)], 0)
    stream = lambda: st.lines_then_exit(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withWatermark("ts", "10 minutes"), wait_ms=3_600_000)
    assert {r.line for r in st.available(stream(), at=at).collect()} == {0, 1}
    logged([("a", i, None) for i in (2, 3, 4)], 1)
    got = {r.line: (r.ends, r.after, r.complete) for r in st.available(stream(), at=at).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 100} and got[100] == (True, 5, True)


def test_all_files_that_are_there_can_be_one_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(datetime(2024, 1, 1, 0, i), i * 60_000_000, i * 60_000_000 + 1_000_000, "x", i) for i in range(9)]
    df = spark.createDataFrame(rows, "ts timestamp, s_us long, e_us long, spk string, id long").repartition(3, "id")
    df.write.parquet(source)
    log = BatchLog(str(tmp_path / "log"), StructType.fromDDL("spk string, s_us long, e_us long, n long"))
    job = lambda: st.session_job(source, df.schema, log, str(tmp_path / "state"), ["spk"], 250_000, ["id"], files_each=None)
    job()
    assert len({p.name for p in (tmp_path / "state" / "sources" / "0").glob("[0-9]*")}) == 1
    st.flush(source, df.schema, {"spk": "", "id": -1})
    job()
    assert sorted(r.s_us for r in log.rows(spark).collect()) == [r[1] for r in rows]
