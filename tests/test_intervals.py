"""Interval vectors: boundary equality, unsorted input, containment, empties."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import intervals as iv

S = 1_000_000


def spans(spark, rows):
    return spark.createDataFrame([("r", int(a * S), int(b * S)) for a, b in rows], "rec string, s_us long, e_us long")


def got(df):
    return sorted((r.s_us / S, r.e_us / S) for r in df.collect())


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, 1), (1.2, 2)], [(0, 2)]),
        ([(0, 1), (1.3, 2)], [(0, 1), (1.3, 2)]),
        ([(0, 1), (1.25, 2)], [(0, 2)]),
        ([(5, 6), (0, 1), (1.1, 2)], [(0, 2), (5, 6)]),
        ([(0, 10), (1, 2), (9, 9.5)], [(0, 10)]),
        ([(3, 3)], []),
        ([], []),
    ],
)
def test_union_joins_over_the_gap_inclusively(spark, rows, want):
    assert got(iv.union(spans(spark, rows), ["rec"], 250_000)) == want
    assert got(iv.session_union(spans(spark, rows), ["rec"], 250_000)) == want


def turns(spark, rows):
    return spark.createDataFrame([("r", k, i, int(a * S), int(b * S)) for i, (k, a, b) in enumerate(rows)], "rec string, spk string, turn_id long, s_us long, e_us long")


def test_overlap_counts_speakers_and_joins_touching_pieces(spark):
    assert got(iv.overlap(turns(spark, [("a", 0, 5), ("b", 3, 8), ("a", 10, 11)]))) == [(3, 5)]
    assert got(iv.overlap(turns(spark, [("a", 0, 5), ("b", 3, 5), ("c", 5, 8), ("d", 5, 7)]))) == [(3, 7)]
    assert got(iv.overlap(turns(spark, [("a", 0, 5), ("a", 3, 8)]))) == []


def test_solo_leaves_out_overlap(spark):
    assert got(iv.solo(turns(spark, [("a", 0, 5), ("b", 2, 3)]), "a")) == [(0, 2), (3, 5)]
    assert got(iv.solo(turns(spark, [("a", 0, 5)]), "missing")) == []


def test_complement_and_padding(spark):
    silent = spark.createDataFrame([("r", 2 * S, 3 * S), ("r", 8 * S, None)], "rec string, s_us long, e_us long")
    assert got(iv.complement(silent, ["rec"], 10 * S)) == [(0, 2), (3, 8)]
    assert got(iv.padded(spans(spark, [(0.1, 9.95)]), 100_000, 10 * S)) == [(0, 10)]


def test_chunks_tiles_and_splits(spark):
    total = lambda n: spark.createDataFrame([("r", int(n))], "rec string, n long")
    assert got(iv.chunk_cover(total(250 * S), ["rec"], "n", 100 * S)) == [(0, 100), (100, 200), (200, 250)]
    assert got(iv.chunk_cover(total(100 * S), ["rec"], "n", 100 * S)) == [(0, 100)]
    assert got(iv.chunk_cover(total(0), ["rec"], "n", 100 * S)) == []
    assert got(iv.chunk_cover(total(500 * S), ["rec"], "n", 0)) == [(0, 500)]
    assert got(iv.tiles(spans(spark, [(0, 26)]), ["rec"], 12 * S, 4 * S)) == [(0, 12), (12, 24)]
    assert got(iv.equal_split(spans(spark, [(0, 10)]), ["rec"], 4 * S, S)) == [(0, 3.333), (3.333, 6.667), (6.667, 10)]


def test_speech_ratio(spark):
    ratio = lambda rows, total: [r.ratio for r in iv.speech_ratio(spans(spark, rows), ["rec"], int(total * S)).collect()]
    assert ratio([(0, 1), (2, 3)], 4) == [0.5]
    assert ratio([(0, 2)], 0) == [0.0]
    assert ratio([(0, 10)], 4) == [1.0]


def test_range_join_finds_each_pair_once(spark):
    a = spans(spark, [(0, 100), (50, 51), (99, 130)])
    met = iv.range_join(a, a, "rec", 10 * S).filter("l_s_us < r_s_us")
    assert sorted((r.l_s_us // S, r.r_s_us // S) for r in met.collect()) == [(0, 50), (0, 99)]


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = turns(spark, [("a", i * 0.7, i * 0.7 + 1) for i in range(50)] + [("b", i * 1.3, i * 1.3 + 0.4) for i in range(30)])
        assert len(got(iv.overlap(rows))) == 28  # "a" speaks until 35.3 s
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def random_spans(rng, n, most=4000):
    rows = []
    for i in range(n):
        a = rng.randrange(most)
        rows.append((rng.choice("ab"), i, a, a + rng.choice([0, 1, 7, 60, 900])))
    return rows


def test_joins_by_overlap_equal_brute_force(spark):
    """Spans and windows met by key and time bucket: buckets shorter and longer than the spans give the same rows."""
    import random

    rng = random.Random(1)
    spans, regions = random_spans(rng, 120), random_spans(rng, 40)
    s = spark.createDataFrame([(k, a, b) for k, _, a, b in spans], "rec string, s_us long, e_us long")
    r = spark.createDataFrame(regions + [("c", 99, 5, 50)], "rec string, region_id long, s_us long, e_us long")
    regions = regions + [("c", 99, 5, 50)]
    for bucket in (13, 300, 10**7):
        met = iv.clip_to_regions(s, r, ["rec"], bucket)
        want = sorted((k, i, max(a, c) - a, min(b, d) - a) for k, i, a, b in regions for q, _, c, d in spans if q == k and c < b and a < d)
        assert sorted(map(tuple, met.collect())) == want
        heard = iv.overlap_of_windows(r.filter("e_us > s_us"), s, ["rec"], bucket_us=bucket)
        want = {i: sum(max(0, min(b, d) - max(a, c)) for q, _, c, d in spans if q == k) for k, i, a, b in regions if b > a}
        assert {x.region_id: x.voiced_us for x in heard.collect()} == want and want[99] == 0
        points = r.select("rec", "region_id", F.col("s_us").alias("t_us"))
        inside = iv.points_inside(points, s, ["rec"], 2, bucket)
        assert sorted(x.region_id for x in inside.collect()) == sorted(i for k, i, a, _ in regions if any(q == k and c + 2 < a < d - 2 for q, _, c, d in spans))
        snapped = iv.snap_outward(r.filter("e_us > s_us"), s.filter("e_us > s_us"), ["rec"], 10**6, 3, bucket)
        real = [x for x in spans if x[3] > x[2]]
        want = {}
        for k, i, a, b in regions:
            if b > a:
                low = [c for q, _, c, d in real if q == k and c - 3 < a < d + 3]
                high = [d for q, _, c, d in real if q == k and c - 3 < b < d + 3]
                want[i] = (max(0, min([a, *low])), max([b, *high]))
        assert {x.region_id: (x.s_us, x.e_us) for x in snapped.collect()} == want


def test_overlap_joins_are_equi_joins_on_key_and_bucket(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        s = spark.createDataFrame([("a", 1, 5)], "rec string, s_us long, e_us long")
        r = s.withColumn("region_id", F.lit(1))
        p = r.withColumnRenamed("s_us", "t_us")
        for df in (iv.clip_to_regions(s, r, ["rec"]), iv.overlap_of_windows(r, s, ["rec"]), iv.snap_outward(r, s, ["rec"], 9), iv.points_inside(p, s, ["rec"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in plan.splitlines() if "SortMergeJoin" in x]
            assert joins and all("bucket" in x.split("], [")[0] and "rec" in x.split("], [")[0] for x in joins)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recordings_without_spans_are_free(spark):
    held = spark.createDataFrame([("a", 2, 5)], "rec string, s_us long, e_us long")
    recs = spark.createDataFrame([("a",), ("b",)], "rec string")
    assert sorted(map(tuple, iv.complement(held, ["rec"], 9, recs).collect())) == [("a", 0, 2), ("a", 5, 9), ("b", 0, 9)]


def test_chunks_are_halved_down_to_the_floor(spark):
    second = 1_000_000
    chunks = spark.createDataFrame([(1, 0, 100 * second), (2, 0, 20 * second), (3, 0, 70 * second)], "k int, s_us long, e_us long")
    fits = (F.col("e_us") - F.col("s_us") <= 40 * second) & (F.col("k") != 3)
    got = sorted(map(tuple, iv.halved(chunks, ["k"], fits).collect()))
    assert [g for g in got if g[0] == 2] == [(2, 0, 20 * second, False)]
    one = [g for g in got if g[0] == 1]
    assert [g[1:3] for g in one[:2]] == [(0, 25_001_500), (25_001_500, 50_001_000)] and len(one) == 4 and not any(g[3] for g in one)
    assert one[-1][2] == 100 * second and all(a[2] == b[1] for a, b in zip(one, one[1:], strict=False))
    three = [g for g in got if g[0] == 3]
    assert all(g[3] and g[2] - g[1] <= 30 * second for g in three) and three[-1][2] == 70 * second


def brute_union(rows, gap):
    out = []
    for s, e in sorted(r for r in rows if r[1] > r[0]):
        if out and s <= out[-1][1] + gap:
            out[-1] = [out[-1][0], max(out[-1][1], e), out[-1][2] + 1]
        else:
            out.append([s, e, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0, 7])
@pytest.mark.parametrize("bucket", [5, 40, 10**9])
def test_scans_in_two_levels_equal_one_scan(spark, gap, bucket):
    """One recording, short buckets: spans and islands that cover many of them, and empty ones between."""
    rng = random.Random(bucket + gap)
    rows = []
    for rec in ("a", None, "c"):
        at = -60
        for _ in range(120):
            at += rng.choice([0, 1, 3, 9, 30, 200])
            rows.append((rec, rng.choice(["x", "y", "z"]), at, at + rng.choice([-1, 0, 1, 4, 20, 90, 400])))
    turns = spark.createDataFrame(rows, "rec string, spk string, s_us long, e_us long")
    for rec in ("a", None, "c"):
        own = [(s, e) for r, _, s, e in rows if r == rec]
        got = iv.union(turns, ["rec"], gap, bucket).filter(F.col("rec").eqNullSafe(F.lit(rec))).collect()
        assert sorted((r.s_us, r.e_us, r.n) for r in got) == brute_union(own, gap)
        pieces = iv.sweep(iv.edges(iv.positive(turns), ["rec"], {"depth": 1}), ["rec"], ["depth"], bucket).filter(F.col("rec").eqNullSafe(F.lit(rec))).collect()
        times = sorted({t for s, e in own if e > s for t in (s, e)})
        assert sorted((r.s_us, r.e_us, r.depth) for r in pieces) == [(a, z, sum(s <= a and e >= z for s, e in own if e > s)) for a, z in zip(times, times[1:])]


def test_no_window_runs_over_a_whole_recording(spark, monkeypatch):
    monkeypatch.setattr(iv, "materialised", lambda df: df)
    turns = spark.createDataFrame([("a", "x", 0, 5)], "rec string, spk string, s_us long, e_us long")
    for df in (iv.union(turns, ["rec"]), iv.overlap(turns), iv.solo(turns, "x"), iv.complement(turns, ["rec"], 10)):
        specs = [line.split("windowspecdefinition(")[1] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition(" in line]
        assert specs and all("bucket" in s for s in specs)
