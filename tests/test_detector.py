"""Detector post-processing against a frame-by-frame automaton."""

import random

import pytest

from quillon.operators import detector as dt


def automaton(probabilities, s):
    """One recording, a dict of frame to probability: spans (first, past, part) by a loop over frames."""
    state, run_flag, run_first, run, spans, before = False, None, 0, 0, [], None
    frames = sorted(probabilities)

    def confirm(at):
        nonlocal state
        if run == (s.least_speech if run_flag else s.least_silence) and state != run_flag:
            state = run_flag
            if state:
                spans.append([run_first, None])
            else:
                spans[-1][1] = run_first

    for f in frames:
        last = [probabilities[f - k] for k in range(s.smooth) if f - k in probabilities]
        flag = sum(last) / len(last) >= s.threshold
        if flag != run_flag or before != f - 1:
            run_flag, run_first, run = flag, f, 0
        run, before = run + 1, f
        confirm(f)
    if spans and spans[-1][1] is None:
        spans[-1][1] = frames[-1] + 1
    merged = []
    for a, z in spans:
        if merged and a - merged[-1][1] <= s.merge_silence + 2 * s.extend:
            merged[-1][1] = z
        else:
            merged.append([a, z])
    out = []
    for a, z in merged:
        a, z = max(a - s.extend, 0), min(z + s.extend, frames[-1] + 1)
        parts = -(-(z - a) // s.most_speech)
        out += [(a + (z - a) * i // parts, a + (z - a) * (i + 1) // parts, i) for i in range(parts)]
    return out


@pytest.mark.parametrize("settings", [dt.Settings(block=64), dt.Settings(least_speech=6, least_silence=3, most_speech=25, merge_silence=2, extend=2, block=17), dt.Settings(smooth=1, least_speech=1, least_silence=1, block=5)])
def test_spans_equal_the_automaton(spark, settings):
    rng = random.Random(settings.block)
    recordings = {}
    for r in range(6):
        level, p = 0.5, {}
        for f in range(rng.choice([3, 40, 400])):
            level = min(1.0, max(0.0, level + rng.choice([-0.25, 0, 0.25]) + (0.5 - level) * 0.05))
            p[f] = int(level * 16) / 16
        recordings[r] = p
    recordings[7] = dict.fromkeys(range(90), 1.0)
    rows = [(r, f, p) for r, own in recordings.items() for f, p in own.items()] + [(8, 0, None), (8, 1, None)]
    got = dt.spans(spark.createDataFrame(rows, "rec int, frame long, p double"), "rec", settings).collect()
    want = sorted((r, *x) for r, p in recordings.items() for x in automaton(p, settings))
    assert sorted((r.rec, r.first, r.past, r.part) for r in got) == want and want
    assert all(r.s_us == r.first * 10_000 and r.e_us == r.past * 10_000 and 0 <= r.mean_p <= 1 for r in got)


def test_a_missing_frame_ends_a_run_and_no_frames_give_no_spans(spark):
    s = dt.Settings(smooth=1, least_speech=4, least_silence=2, block=8)
    rows = [(1, f, 1.0) for f in (0, 1, 2, 3, 10, 11, 12, 20, 21, 22)]
    got = dt.spans(spark.createDataFrame(rows, "rec int, frame long, p double"), "rec", s).collect()
    assert [(r.first, r.past) for r in got] == [(0, 4), (10, 13), (20, 23)]
    assert dt.spans(spark.createDataFrame([], "rec int, frame long, p double"), "rec", s).count() == 0


def test_no_window_runs_over_all_frames_of_a_recording(spark):
    frames = spark.createDataFrame([(1, 0, 1.0)], "rec int, frame long, p double")
    plan = dt.smoothed(frames, "rec")._jdf.queryExecution().optimizedPlan().toString()
    assert all("block" in line.split("windowspecdefinition(")[1] for line in plan.splitlines() if "windowspecdefinition(" in line)
