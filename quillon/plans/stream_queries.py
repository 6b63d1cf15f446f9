"""Registered streaming, extension and rule queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions import registry as rg
from quillon.functions import rules as ru
from quillon.functions import text as tx
from quillon.operators import intervals as iv
from quillon.operators.vectors import cosine
from quillon.plans.domain import TURNS_SQL, table, turns
from quillon.plans.interval_queries import islands
from quillon.plans.shared import materialised, shared_path
from quillon.sources import readers as rd
from quillon.streaming import jobs as st
from quillon.streaming.logs import BatchLog

WINDOW_S = 300


def _events(spark, d):
    return st.read(spark, f"{d}/events.parquet")


def stm_tumbling(spark, d):
    return st.latest(st.tumbling(_events(spark, d), WINDOW_S, ["event_type"]), ["event_type", "starts"], "n")


def stm_stage_state(spark, d):
    rows = _events(spark, d).select("user_id", (F.col("event_id") % 7).alias("stage"))
    return st.latest(st.stage_state(rows, "user_id", "stage"), ["user_id"], "n")


def stm_incremental(spark, d):
    """Users seen on the stream, each worked off once although the stream is read twice."""
    done = shared_path(spark, "manifest")
    for _ in range(2):
        st.skip_done(_events(spark, d).select("user_id"), done, "user_id")
    return spark.read.parquet(done)


def stm_session_union(spark, d):
    """Sessions of turns on the stream, open ones too: what `iv.session_union` gives for the rows as a batch.

    There is no watermark, as it would drop late rows; all sessions are kept as state.
    """
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, d).select(F.col("event_type").alias("spk"), ts.alias("s_us"), (ts + F.round(F.col("value") * 1e6).cast("long")).alias("e_us"))
    return st.complete(iv.session_union(rows, ["spk"], iv.GAP_US))


def stm_tumbling_text(spark, d):
    """Texts of a conversation on the stream, joined in order within chunks of four turns; blank ones are skipped."""
    rows = st.read(spark, f"{d}/conversations.parquet").withColumn("chunk", F.floor(F.col("turn") / 4))
    return st.complete(st.joined_text(rows, ["conv_id", "chunk"], "turn", "text"))


def stm_sliding(spark, d):
    """Events of a type in windows of ten minutes, one every five."""
    return st.latest(st.sliding(_events(spark, d), 2 * WINDOW_S, WINDOW_S, ["event_type"]), ["event_type", "starts"], "n")


def _exits_first(spark, d):
    """A log of runs in four parts: every tenth event of a user is an exit that expects all other lines, and exits come in the first part."""
    events = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("line"), (F.col("event_id") % 10 == 0).alias("ends"))
    expected = events.groupBy("run").agg(F.count_if(~F.col("ends")).alias("lines"))
    rows = events.join(expected, "run").select("run", "line", F.when(F.col("ends"), F.col("lines")).alias("expected"))
    part = F.when(F.col("expected").isNotNull(), 0).otherwise(F.pmod(F.hash("line"), F.lit(3)) + 1)
    return materialised(rows.withColumn("part", part).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("part"))))


def _ordered(spark, d):
    """The parts are logged one after another, in as many files as there are tasks; the stream takes a part as one batch and goes on from its state."""
    rows, path = _exits_first(spark, d), shared_path(spark, "runs")
    at = shared_path(spark, "streams"), shared_path(spark, "stream-state")
    for i in range(4):
        rows.filter(F.col("part") == i).drop("part").write.mode("append").parquet(path)
        log = spark.readStream.schema(rows.drop("part").schema).parquet(path).withWatermark("ts", "10 minutes")
        given = st.available(st.lines_then_exit(log, wait_ms=3_600_000), at=at)
    return given


def stm_line_order(spark, d):
    """Lines of a run before its end: the end is given out after the last line, whatever came first; numbered in that order."""
    given = _ordered(spark, d)
    order = Window.partitionBy("run").orderBy("ends", "line")
    return given.select(F.col("run").alias("user_id"), (F.row_number().over(order) - 1).alias("nth"), F.col("line").alias("event_id"), "ends")


def stm_exits(spark, d):
    """Exits of a run, how many lines were given out before each, and whether all were."""
    return _ordered(spark, d).filter("ends").select(F.col("run").alias("user_id"), F.col("line").alias("event_id"), "after", "complete")


def stm_session_log(spark, d):
    """Sessions of turns on the stream, every turn twice, with a watermark; the stream dies in the middle, goes on, and is flushed."""
    ts = F.col("ts").cast("timestamp")
    start = F.unix_micros(ts)
    rows = table(spark, d, "events").select(F.col("event_type").alias("spk"), "event_id", ts.alias("ts"), start.alias("s_us"), (start + F.round(F.col("value") * 1e6).cast("long")).alias("e_us"))
    source, state = shared_path(spark, "turns"), shared_path(spark, "stream-state")
    # two halves in order of time, each with its rows twice, and each a batch of as many files as there are tasks
    middle = rows.agg(F.expr("percentile_approx(s_us, 0.5)").alias("m")).first().m or 0

    def logged(half):
        own = rows.filter(half)
        own.unionByName(own).write.mode("append").parquet(source)

    log = BatchLog(shared_path(spark, "streams"), StructType.fromDDL("spk string, s_us long, e_us long, n long"))
    job = lambda most=None: st.session_job(source, rows.schema, log, state, ["spk"], iv.GAP_US, ["event_id"], most_batches=most, files_each=None)
    logged(F.col("s_us") <= middle)
    job(1)
    logged(F.col("s_us") > middle)
    job()
    st.flush(source, rows.schema, {"spk": "", "event_id": -1})
    job()
    return log.rows(spark)


def udtf_chunks(spark, d):
    rg.install(spark)
    table(spark, d, "documents").select("doc_id", F.length("text").alias("n")).createOrReplaceTempView("quillon_lengths")
    return spark.sql("SELECT doc_id, c.chunk, c.s_us, c.e_us FROM quillon_lengths, LATERAL chunks(n, 1000) AS c")


def udf_scorer(spark, d):
    """The pandas scorer against the built-in cosine: every vector and its label's first."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    first = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("p"))
    score = rg.create("scorer", "cosine")
    return rows.join(first, "label").select("vec_id", F.round(score("v", "p"), 6).alias("score"), F.round(cosine(F.col("v"), F.col("p")), 6).alias("builtin"))


def udf_stages(spark, d):
    """A chain of stages by settings: clips are trimmed, short ones dropped, and the stage that is switched off is left out."""
    stages = [
        rg.Stage("trim", lambda rows, _: rows.withColumn("text", F.trim("text"))),
        rg.Stage("long_enough", lambda rows, given: rows.filter(F.length("text") >= given["least"]), needs=("least",)),
        rg.Stage("none", lambda rows, _: rows.limit(0), on=lambda given: given.get("none", False)),
    ]
    return rg.run_stages(table(spark, d, "documents").select("doc_id", "text"), stages, {"least": 500}).select("doc_id", F.length("text").alias("n"))


def udf_fallback(spark, d):
    """A model that cannot be loaded gives nulls in place of an error."""

    def broken():
        raise RuntimeError("no weights here")

    rows = table(spark, d, "documents").select("doc_id", "lang")
    score = lambda model, batch: batch.assign(score=None if model is None else 1.0)[["doc_id", "score"]]
    return rg.map_model(rows, broken, score, "doc_id long, score double", or_none=True)


def udf_registry(spark, d):
    """What a mapped model sees: how many transcripts of each language a task's batches hold in all."""
    rows = rg.map_model(table(spark, d, "documents").select("lang", "text"), dict, lambda model, batch: batch.assign(n=batch["text"].str.len())[["lang", "n"]], "lang string, n long")
    return rows.groupBy("lang").agg(F.sum("n").alias("n_chars"), F.count("*").alias("n_docs"))


def rule_policies(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "low").alias("forced"), (F.col("c_custkey") % 5 != 0).alias("gpu"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") / 500).alias("free"), (F.col("c_acctbal") / 300).alias("total"))
    policy = ru.memory_policy(F.col("forced"), F.col("gpu"), F.col("free"), F.col("total"))
    return rows.select("c_custkey", policy.alias("policy"), ru.chunk_seconds(policy).alias("chunk_s"))


def rule_verdicts(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / -100).alias("v"), (F.col("c_acctbal") / -120).alias("b"), F.col("c_mktsegment").alias("m"), F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".WAV").otherwise(".txt")).alias("path"))
    return rows.select("c_custkey", ru.clean_verdict(F.col("v"), F.col("b")).alias("verdict"), ru.is_media(F.col("path")).alias("media"), ru.same_model(F.concat(F.lit(" "), F.lower("m")), F.when(F.col("c_custkey") % 3 != 0, F.col("m"))).alias("same"))


def rule_timeouts(spark, d):
    raw = F.when(F.col("o_orderkey") % 4 == 0, "junk").when(F.col("o_orderkey") % 4 == 1, F.lit("0")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit(" "), (F.col("o_orderkey") % 1000).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", ru.timeout_seconds(raw).alias("seconds"))


def src_turn_lines(spark, d):
    lines = turns(spark, d).select("turn_id", F.concat(tx.milli_seconds(F.col("s_us")), F.lit("  "), tx.milli_seconds(F.col("e_us")), F.lit(" "), "spk", F.lit("\nbad line\n5 5 x")).alias("text"))
    return rd.turn_lines(lines, "turn_id", "text")


def src_settings(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "junk").otherwise(F.concat(F.lit('{"device":"'), "c_mktsegment", F.lit('","other":1}'))).alias("text"))
    return rd.settings(rows, "text", {"device": "cuda", "precision": "fp32"}).select("c_custkey", "device", "precision")


QUERIES = {f.__name__: f for f in (stm_tumbling, stm_stage_state, stm_incremental, stm_session_union, stm_tumbling_text, stm_sliding, stm_line_order, stm_exits, stm_session_log, udtf_chunks, udf_scorer, udf_stages, udf_fallback, udf_registry, rule_policies, rule_verdicts, rule_timeouts, src_turn_lines, src_settings)}

ORACLE_SQL = {
    "stm_session_union": f"WITH spoken AS (SELECT event_type AS spk, epoch_us(ts) AS s_us, epoch_us(ts) + CAST(round(value * 1e6) AS BIGINT) AS e_us FROM events WHERE CAST(round(value * 1e6) AS BIGINT) > 0), {islands('spoken', 'u', 'spk', iv.GAP_US)} SELECT spk, s_us, e_us, n FROM u",
    "stm_session_log": f"WITH spoken AS (SELECT event_type AS spk, epoch_us(ts) AS s_us, epoch_us(ts) + CAST(round(value * 1e6) AS BIGINT) AS e_us FROM events WHERE CAST(round(value * 1e6) AS BIGINT) > 0), {islands('spoken', 'u', 'spk', iv.GAP_US)} SELECT spk, s_us, e_us, n FROM u",
    "stm_exits": "SELECT user_id, event_id, (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND o.event_id % 10 <> 0) AS after, true AS complete FROM events e WHERE event_id % 10 = 0",
    "stm_sliding": f"SELECT event_type, (epoch_us(ts) // {WINDOW_S * 1_000_000} - b) * {WINDOW_S} AS starts, count(*) AS n, max(event_id) AS last_id FROM events, (VALUES (0), (1)) AS x(b) GROUP BY ALL",
    "stm_line_order": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 = 0, event_id) - 1 AS INT) AS nth, event_id, event_id % 10 = 0 AS ends FROM events",
    "udf_stages": "SELECT doc_id, length(trim(text, ' ')) AS n FROM documents WHERE length(trim(text, ' ')) >= 500",
    "udf_fallback": "SELECT doc_id, CAST(NULL AS DOUBLE) AS score FROM documents",
    "stm_tumbling": f"SELECT event_type, epoch_us(ts) // {WINDOW_S * 1_000_000} * {WINDOW_S} AS starts, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY ALL",
    "stm_stage_state": "SELECT user_id, max(event_id % 7) AS reached, count(*) AS n FROM events GROUP BY user_id",
    "stm_incremental": "SELECT DISTINCT user_id FROM events",
    "stm_tumbling_text": "SELECT conv_id, turn // 4 AS chunk, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE trim(text) <> '' GROUP BY ALL",
    "udtf_chunks": "WITH l AS (SELECT doc_id, length(text) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, n, 1000)) AS s_us FROM l WHERE n > 0) SELECT doc_id, CAST(s_us // 1000 AS INT) AS chunk, s_us, least(s_us + 1000, n) AS e_us FROM c",
    "udf_scorer": "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT label, arg_min(v, vec_id) AS p FROM v GROUP BY label), s AS (SELECT vec_id, round(list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p))), 6) AS score FROM v JOIN p USING (label)) SELECT vec_id, score, score AS builtin FROM s",
    "udf_registry": "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_docs FROM documents GROUP BY lang",
    "rule_policies": "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'low' WHEN c_custkey % 5 = 0 THEN 'cpu' WHEN coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 500 END, c_acctbal / 300) < 10 THEN 'low' ELSE 'default' END AS policy FROM customer) SELECT c_custkey, policy, CASE policy WHEN 'low' THEN 60 ELSE 120 END AS chunk_s FROM p",
    "rule_verdicts": "SELECT c_custkey, CASE WHEN c_acctbal / -100 <= -50 THEN 'kept_original' WHEN c_acctbal / -120 <= -45 THEN 'already_clean' ELSE 'cleaned' END AS verdict, c_custkey % 2 = 0 AS media, c_custkey % 3 <> 0 AS same FROM customer",
    "rule_timeouts": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1800.0 WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN o_orderkey % 1000 > 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END ELSE 1800.0 END AS seconds FROM orders",
    "src_turn_lines": f"WITH {TURNS_SQL} SELECT turn_id, 0 AS track, spk, (s_us + 500) // 1000 * 1000 AS s_us, (e_us + 500) // 1000 * 1000 AS e_us FROM turns WHERE (e_us + 500) // 1000 > (s_us + 500) // 1000",
    "src_settings": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cuda' ELSE c_mktsegment END AS device, 'fp32' AS precision FROM customer",
}
