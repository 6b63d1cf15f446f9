"""Queries on numbers that only larger tables have, and on halves that are no doubles."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import audio as au


def same_as_sql(spark, tmp_path, name, table):
    got = catalog.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    cursor = c.execute(catalog.ORACLE_SQL[name])
    at = [x[0] for x in cursor.description]
    assert sorted(tuple(r[n] for n in at) for r in got.collect()) == sorted(cursor.fetchall())


def test_reel_of_more_gaps_than_an_int_has_microseconds(spark):
    rows = spark.range(5000).select(F.lit("r").alias("rec"), F.col("id").alias("clip_id"), F.col("id").alias("s_us"), F.lit(10).cast("long").alias("dur_us"))
    last = au.reel(rows, ["rec"], 500_000).orderBy(F.desc("nth")).first()
    assert (last.nth, last.offset_us) == (4999, 4999 * 500_010)


@pytest.mark.parametrize("name", ["int_halved", "int_chunk_cover"])
def test_long_texts_have_more_microseconds_than_an_int(spark, tmp_path, name):
    rows = spark.range(6).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") < 3, 300_000 + F.col("id").cast("int")).otherwise(9)).alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, tmp_path, name, "documents")


def test_silences_round_halves_as_the_sql_does(spark, tmp_path):
    # halves of a thousandth of which the doubles are just below the half
    low = [us for us in range(500, 86_400_000_000, 9_973_000) if us / 1_000_000 * 1000 % 1 < 0.5][:40]
    assert len(low) == 40
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=us), "x", 1.5) for i, us in enumerate(low)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, tmp_path, "src_silences", "events")
