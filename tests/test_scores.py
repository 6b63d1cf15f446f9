"""Fusion, vectors, gate, comparison, mining and the segmenter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import compare as co
from quillon.operators import fusion as fu
from quillon.operators import gate as ga
from quillon.operators import mining as mi
from quillon.operators import segmenter as sg
from quillon.operators import vectors as ve


@pytest.mark.parametrize(
    "scores, factor, want",
    [((0.8, 0.6, 0.4), 1.0, 0.62), ((1.0, 1.0, 1.0), 1.0, 1.0), ((0.8, 0.6, 0.4), 0.1, 0.062), ((0.9, 0.0, 0.9), 1.0, 0.63), ((0.888, None, 0.888), 1.0, 0.888), ((0.8, 0.6, None), 1.0, 0.5 / 0.7), ((None, None, None), 1.0, 0.0)],
)
def test_weighted_fusion_renormalises(spark, scores, factor, want):
    row = spark.createDataFrame([(*scores, factor)], "a double, b double, c double, f double")
    assert row.select(fu.weighted([F.col("a"), F.col("b"), F.col("c")], F.col("f"))).first()[0] == pytest.approx(want)


def test_centroid_and_guarded_cosine(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (1, [30.0, 40.0]), (2, [1.0, 0.0])], "label int, v array<double>")
    assert {r.label: [round(x, 9) for x in r.centroid] for r in ve.centroid(rows, ["label"]).collect()} == {1: [0.6, 0.8], 2: [1.0, 0.0]}
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in pairs.select(ve.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0]
    with pytest.raises(Exception, match="no length"):
        ve.centroid(spark.createDataFrame([(1, [0.0])], "label int, v array<double>"), ["label"]).collect()


def test_identify_fails_closed_and_takes_the_least_label(spark):
    rows = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (2, 1, 0.0), (2, 2, 0.0)], "k int, label int, similarity double")
    assert {r.k: r.label for r in ve.identify(rows, ["k"], "label").collect()} == {1: 3, 2: None}


def clip(spark, **over):
    base = {"clip_id": "c", "transcript": "hello", "language": "en", "dur_us": 2_000_000, "silence_validated": True, "verified": True} | over
    kinds = {"dur_us": "long", "silence_validated": "boolean", "verified": "boolean", "peak": "double", "true_peak_db": "double", "n_samples": "long", "has_audio": "boolean"}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in base))


@pytest.mark.parametrize(
    "over, want",
    [
        ({}, {}),
        ({"dur_us": 400_000}, {"duration_too_short": 0.4}),
        ({"dur_us": 15_000_000}, {}),
        ({"dur_us": 15_000_001}, {"duration_too_long": 15.0}),
        ({"transcript": "  "}, {"empty_transcript": 1.0}),
        ({"transcript": None, "silence_validated": False}, {"empty_transcript": 1.0, "not_silence_validated": 1.0}),
        ({"verified": None}, {"not_verified": 1.0}),
        ({"peak": 1.0, "true_peak_db": 0.5}, {"clipping": 0.0}),
        ({"peak": 0.5, "true_peak_db": 0.5}, {"true_peak_exceeds": 0.5}),
        ({"n_samples": 0}, {"empty_audio": 1.0}),
        ({"has_audio": False}, {"no_audio": 1.0}),
    ],
)
def test_gate_names_every_reason(spark, over, want):
    row = ga.gate(clip(spark, **over)).first()
    assert row.reasons == want and row.accepted == (not want)


def words_off(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors_equal_an_edit_distance_over_words(spark):
    rng = np.random.default_rng(1)
    pairs = [("", ""), ("", "a"), ("a b", ""), ("a b c", "a x c d")]
    pairs += [tuple(" ".join(rng.choice(list("abcdefg"), rng.integers(1, 30))) for _ in "ab") for _ in range(20)]
    df = spark.createDataFrame(pairs, "r string, h string")
    for row in co.word_errors(df, "r", "h").collect():
        r, h = row.r.split(), row.h.split()
        assert row.wer == pytest.approx((words_off(r, h) / len(r)) if r else float(bool(h)))


def test_jaccard_and_score_delta(spark):
    run = lambda rows: spark.createDataFrame(rows, "k int, item int, score double")
    a, b = run([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.1)]), run([(1, 2, 0.75), (1, 3, 0.5), (2, 1, 0.3)])
    assert {r.k: r.jaccard for r in co.jaccard(a, b, ["k"], "item").collect()} == {1: pytest.approx(1 / 3), 2: 1.0}
    assert {r.k: r.delta for r in co.score_delta(a, b, ["k"], "item", "score").collect()} == {1: float("inf"), 2: pytest.approx(0.2)}


def test_diverse_picks_keep_apart_then_fill_up(spark):
    s = 1_000_000
    rows = spark.createDataFrame([("r", 0, 10 * s, 9.0), ("r", 5 * s, 15 * s, 8.0), ("r", 60 * s, 70 * s, 7.0), ("r", 62 * s, 72 * s, 6.0)], "rec string, s_us long, e_us long, score double")
    picks = lambda n: [r.score for r in mi.diverse(rows, ["rec"], n, 20 * s).orderBy("pick").collect()]
    assert picks(2) == [9.0, 7.0] and picks(3) == [9.0, 7.0, 8.0] and picks(9) == [9.0, 7.0, 8.0, 6.0]


def plain_picks(windows, limit, apart):
    """One pass over the windows in order, then the best that are left."""
    ordered = sorted(set(windows), key=lambda w: (-w[2], w[0], w[1]))
    first = []
    for s, e, score in ordered:
        if len(first) < limit and all(abs((s + e) - (p[0] + p[1])) >= 2 * apart for p in first):
            first.append((s, e, score))
    return (first + [w for w in ordered if w not in first])[:limit]


@pytest.mark.parametrize("limit, apart", [(1, 50), (4, 0), (5, 30), (8, 90), (200, 3)])
def test_diverse_picks_equal_a_plain_pass(spark, limit, apart):
    rng = np.random.default_rng(limit)
    rows = []
    for rec in ("a", "b", None):
        starts = rng.integers(0, 400, 60)
        rows += [(rec, int(s), int(s + n), float(k)) for s, n, k in zip(starts, rng.integers(1, 40, 60), rng.integers(0, 9, 60))]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "rec string, s_us long, e_us long, score double")
    got = [(r.rec, r.pick, r.s_us, r.e_us, r.score) for r in mi.diverse(df.repartition(3), ["rec"], limit, apart).collect()]
    want = [(rec, i, *w) for rec in ("a", "b", None) for i, w in enumerate(plain_picks([r[1:] for r in rows if r[0] == rec], limit, apart))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert mi.diverse(df.limit(0), ["rec"], limit, apart).count() == 0


def test_walk_cuts_in_silence_and_flags_forced_cuts():
    limits = sg.Limits(least=0.5, most=1.0, hard=1.5)
    speech = np.ones(600, bool)
    zones = []
    for a in range(80, 600, 90):
        speech[a : a + 8] = False
        zones.append((a, a + 7, a + 3, False))
    levels = np.where(speech, -10.0, -60.0)
    clips = sg.walk(sg.Region(levels, speech, zones, True, True, True), limits)
    assert clips[0][0] == 0 and clips[-1][1] == 600
    assert all(ok for *_, ok in clips)
    assert all(not speech[a] for a, _, _ in clips[1:]) and all(b - a <= 150 for a, b, _ in clips)
    forced = sg.walk(sg.Region(np.full(600, -10.0), np.ones(600, bool), [], True, True, True), limits)
    assert len(forced) > 2 and not any(ok for *_, ok in forced[:-1])
    assert not any(ok for *_, ok in sg.walk(sg.Region(levels, speech, [], False, False, False), limits))
    assert sg.walk(sg.Region(np.zeros(0), np.zeros(0, bool), [], True, True, True), limits) == []


def test_identify_takes_names_and_signs(spark):
    rows = spark.createDataFrame([(1, "bob", 0.5), (1, "ann", 0.5), (2, "ann", 0.0), (2, "bob", -0.4), (3, "ann", 0.0), (3, "bob", 0.0)], "k int, label string, similarity double")
    assert {r.k: (r.label, r.similarity) for r in ve.identify(rows, ["k"], "label").collect()} == {1: ("ann", 0.5), 2: ("ann", 0.0), 3: (None, 0.0)}


def test_nearest_equals_identify_in_blocks_too(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)] + [(99, [0.0] * 4)], "k int, v array<double>")
    protos = spark.createDataFrame([(f"p{i % 9}", rng.normal(size=4).tolist()) for i in range(9)], "name string, centroid array<double>")
    want = {r.k: (r.name, r.similarity) for r in ve.identify(ve.similarities(vectors, protos), ["k"], "name").collect()}
    assert want[99] == (None, 0.0)
    for block in (4096, 4):
        monkeypatch.setattr(ve, "BLOCK_PROTOTYPES", block)
        assert {r.k: (r.name, r.similarity) for r in ve.nearest(vectors, protos, "name").collect()} == want
        assert ve.similarities(vectors, protos).count() == 41 * 9


def test_gate_takes_checks_of_its_own(spark):
    from pyspark.sql import functions as F

    mine = [ga.Check("too_loud", F.length("transcript") > 3, F.length("transcript")), ga.Check("odd", F.lit(None).cast("boolean"))]
    row = ga.gate(clip(spark), more=mine).first()
    assert row.reasons == {"too_loud": 5.0} and not row.accepted


def test_gate_composes_arabic_letters(spark):
    decomposed = "\u0627\u0653 \u0648\u0654 5"
    row = ga.gate(clip(spark, transcript=decomposed, language="ar")).first()
    assert row.normalized == "\u0622 \u0624 \u062e\u0645\u0633\u0629" and row.accepted
    marks = ga.gate(clip(spark, transcript="\u064e \u0651", language="ar-SA")).first()
    assert marks.normalized == "" and marks.reasons == {"empty_transcript": 1.0}


def test_recordings_are_cut_word_safe(spark):
    """Speech with pauses: clips of the wanted length, edges out of speech, validated ones never start in a word."""
    from quillon.operators import frames as fr

    rate, rng = 800, np.random.default_rng(5)
    spans, samples = [], []
    for rec, seconds in (("a", 60), ("b", 45)):
        at = 0.0
        quiet = np.ones(seconds * rate, bool)
        while at < seconds - 3:
            talk = float(rng.uniform(1.0, 4.0))
            spans.append((rec, int(at * 1e6), int((at + talk) * 1e6)))
            quiet[int(at * rate) : int((at + talk) * rate)] = False
            at += talk + float(rng.uniform(0.1, 0.8))
        wave = np.where(quiet, 0.001, 0.3) * rng.normal(size=seconds * rate)
        samples += [(rec, i, float(x)) for i, x in enumerate(wave)]
    speech = spark.createDataFrame(spans, "rec string, s_us long, e_us long")
    sound = spark.createDataFrame(samples, "rec string, pos long, x double")
    totals = spark.createDataFrame([("a", 60_000_000), ("b", 45_000_000), ("c", 5_000_000)], "rec string, total_us long")
    segments = spark.createDataFrame([("a", 500_000, 31_000_000), ("a", 33_000_000, 70_000_000), ("b", 0, 44_000_000), ("b", 7, 7)], "rec string, s_us long, e_us long")
    found = sg.cut_recordings(segments, speech, sound, totals, rate).collect()
    assert {r.rec for r in found} == {"a", "b"} and len(found) >= 7
    inside = lambda r, t: any(k == r and s + 10_000 < t < e - 10_000 for k, s, e in spans)
    assert all(0 <= r.s_us < r.e_us and r.e_us - r.s_us <= 23_000_000 for r in found)
    assert sum(r.validated for r in found) >= len(found) // 2
    assert not [r for r in found if r.validated and inside(r.rec, r.s_us)]
    assert len(sg.cut_recordings(segments, speech, sound, totals, rate, least_us=3_000_000, most_clips=2).collect()) == 4
    deaf = sg.cut_recordings(segments, speech.filter("rec = 'b'"), sound, totals, rate).filter("rec = 'a'").collect()
    assert deaf and not any(r.validated for r in deaf)
    regions = sg.regions_of(segments, speech, totals)
    tracks = sg.tracks_of(regions, speech, sound, rate)
    rows = sg.region_rows(tracks, fr.zones(tracks, "region", 30), "region").selectExpr("*", "true AS vad", "true AS start_safe", "true AS end_safe")
    clips = sg.segment(rows, "region")
    assert clips.count() > 3 and sg.violations(clips, tracks, "region").count() == 0


def test_extraction_gives_a_dataset(spark):
    from quillon.plans import extraction as ex

    rows = ex.extract_end_to_end(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 10 and len({r.clip_id for r in rows}) == len(rows)
    assert all(50_000 <= r.dur_us <= 450_000 and r.normalized and r.speaker == ex.TARGET for r in rows)
    assert sum(r.is_eval for r in rows) == round(len(rows) * 0.1)
