"""Text vectors of transcripts, names and formats."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx


def one(spark, column_of, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column_of(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "said, want",
    [
        ("The 20th episode", "The twentieth episode"),
        ("The 21st episode", "The 21st episode"),
        ("Dr. Smith and Prof. Jones", "Doctor Smith and Professor Jones"),
        ("St. Paul's", "St. Paul's"),
        ("15000 items", "15000 items"),
        ("Yamaha 2000 model", "Yamaha two thousand model"),
        ("v2 scored 3.5", "v2 scored three.five"),
        ("10:30 AM", "ten:thirty AM"),
        ("agent 007 and 21", "agent seven and twenty-one"),
        ("  a \n b\t ", "a b"),
        ("٣ things", "three things"),
        ("id 1234567890123456789012", "id 1234567890123456789012"),
        ("", ""),
        (None, ""),
    ],
)
def test_english_is_read_aloud(spark, said, want):
    assert one(spark, tx.normalize_en, said) == [want]


def test_arabic_is_read_aloud(spark):
    assert one(spark, tx.normalize_ar, "٢٠٢٤", "٠", "١٠٠٠٠", "كـتاب ٢١") == ["ألفان وأربعة وعشرون", "صفر", "10000", "كتاب واحد وعشرون"]
    assert one(spark, tx.is_arabic, "ar", " AR-sa", "ar_EG", "art", None) == [True, True, True, False, False]


def test_names_and_formats(spark):
    assert one(spark, tx.safe_file_name, 'a/b\\c:d*e?f', "  ", "") == ["abcdef", "__", "unnamed_file"]
    assert one(spark, tx.locale, "en", "EN", "fr-FR", "zz", None) == ["en-US", "en-US", "fr-FR", "auto", "auto"]
    assert one(spark, tx.strip_tags, "Hello world. <en-US>") == ["Hello world."]
    assert one(spark, tx.csv_field, 'a|b', 'say "hi"', "plain") == ['"a|b"', '"say ""hi"""', "plain"]
    assert one(spark, tx.log_class, "== STAGE 3: failed", "Traceback", "Warn: x", "fine") == ["banner", "err", "warn", "plain"]
    assert one(spark, tx.stage_of, "== STAGE 6.5a: x", "no") == ["6.5", None]
    us = lambda x: x.cast("long")
    assert one(spark, lambda x: tx.clock(us(x)), "1234500", "3661500000") == ["00:00:01.234", "01:01:01.500"]
    name = spark.range(1).select(tx.segment_name(F.lit(3), F.lit(1_500_000), F.lit(2_750_000)).alias("n"))
    assert name.first().n == "solo_temp_verif_0003_1p500s_to_2p750s"
    s, e = tx.times_of_name(F.col("n"))
    assert tuple(name.select(s, e).first()) == (1_500_000, 2_750_000)


def test_job_key_ignores_case_and_order(spark):
    import hashlib

    row = spark.range(1).select(tx.job_key(F.lit("/A/b.WAV"), F.array(F.lit("Y"), F.lit("x")), F.lit(" T ")).alias("a"), tx.job_key(F.lit("/a/B.wav"), F.array(F.lit("x"), F.lit("y")), F.lit("t")).alias("b")).first()
    assert row.a == row.b == hashlib.sha1("/a/b.wav\0x|y\0t".encode()).hexdigest()[:16]


def test_markup_and_labels(spark):
    assert one(spark, tx.rich_stripped, "[bold]a[/bold] [link]b[/] [GREY42]c [#12ab3f]d[on red]", "[1] plain [x]", "[x [bold] y", "[bold [x] y", "[/] [only] [on\tx] a]b", "[/", None) == ["a [link]b c d", "[1] plain [x]", "[x  y", " y", " [only]  a]b", "[/", None]
    assert one(spark, lambda c: tx.length_label(c.cast("double")), "59.6", "61", "3600", "5430") == ["0:60", "1:01", "1h 00m", "1h 30m"]
    assert one(spark, lambda c: tx.clock_label(c.cast("long")), "999", "61000", "3723000") == ["00:00", "01:01", "1:02:03"]
    assert one(spark, tx.log_class, "Initializing model failed", "Initializing pipeline failed") == ["err", "banner"]
    assert one(spark, lambda c: tx.clip_file_name(c.cast("int"), F.lit(3_249_000), F.lit(7_751_000)), "4", "1234") == ["ref_004_3.2s-7.8s.wav", "ref_1234_3.2s-7.8s.wav"]
