"""Reference clips, prototypes in their own spaces, and scores that are fused over what there is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import verification as vf
from quillon.plans import shared
from quillon.sources import references as rf
from quillon.sources import sound_files as sf
from quillon.sources.sinks import wav_bytes


def made_models():
    """Models that workers can read: functions of a function travel whole."""

    def picky(x):
        if x[0] < 0:
            raise ValueError("negative")
        return np.array([x.sum(), x.max(), 1.0])

    return {"rvector": lambda x: x[:4], "ecapa": picky, "flat": lambda x: np.zeros(3)}


MODELS = made_models()


def clip_rows(n=24):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], rng.normal(size=6).tolist()) for i in range(n)]
    return rows + [(n, "a", []), (n + 1, "a", None), (n + 2, "nobody", [1.0] * 6), (n + 3, None, [1.0] * 6)]


def unit(v):
    return np.asarray(v) / np.linalg.norm(v)


def test_models_fail_one_by_one(spark):
    df = spark.createDataFrame(clip_rows(), "id long, target string, samples array<double>")
    got = {r.id: r for r in vf.embedded(df, MODELS).collect()}
    for i, _, x in clip_rows():
        r = got[i]
        if not x:
            assert r.voices == {} and r.failures == dict.fromkeys(MODELS, "no samples")
            continue
        assert r.voices["rvector"] == pytest.approx(x[:4]) and r.failures["flat"] == "no voice print"
        assert ("ecapa" in r.voices) == (x[0] >= 0) and r.failures.get("ecapa") == (None if x[0] >= 0 else "negative")


@pytest.mark.parametrize("rows", [3, 10_000])
def test_scores_equal_a_plain_loop(spark, monkeypatch, rows):
    monkeypatch.setattr(shared, "SPLIT_ROWS", rows)
    all_rows = clip_rows()
    df = vf.embedded(spark.createDataFrame(all_rows, "id long, target string, samples array<double>"), MODELS)
    found = vf.prototypes(df.filter("id < 8"), "target")
    got = {r.id: r for r in vf.verified(vf.scored(df.repartition(3), found, "target", "id"), F.lit(0.5)).collect()}
    assert len(got) == len(all_rows)
    protos = {}
    for t in "ab":
        own = [x for i, k, x in all_rows if i < 8 and k == t]
        protos[t, "rvector"] = np.mean([unit(x[:4]) for x in own], axis=0)
        ok = [unit(MODELS["ecapa"](np.array(x))) for x in own if x[0] >= 0]
        if ok:
            protos[t, "ecapa"] = np.mean(ok, axis=0)
    for i, t, x in all_rows:
        want = {}
        for slot in vf.SLOTS:
            if not x or (t, slot.model) not in protos or (slot.model == "ecapa" and x[0] < 0):
                continue
            v = MODELS[slot.model](np.array(x))
            want[slot.name] = float(unit(v) @ unit(protos[t, slot.model]))
        assert got[i].scores == pytest.approx(want)
        weight = sum(s.weight for s in vf.SLOTS if s.name in want)
        assert got[i].score == pytest.approx(0.5 * sum(s.weight * want[s.name] for s in vf.SLOTS if s.name in want) / weight if want else 0.0)


def test_spaces_never_meet_and_one_model_can_fill_two_slots(spark):
    schema = "id long, target string, voices map<string,array<double>>"
    refs = spark.createDataFrame([(0, "a", {"x": [1.0, 0.0], "y": [0.0, 1.0, 0.0]})], schema)
    clip = spark.createDataFrame([(1, "a", {"x": [1.0, 0.0], "y": [1.0, 0.0]})], schema)
    slots = (vf.Slot("rvector", "x", 0.4), vf.Slot("ecapa", "y", 0.3), vf.Slot("gemini", "z", 0.3))
    found = vf.prototypes(refs, "target")
    assert vf.scored(clip, found, "target", "id", slots).first().scores == {"rvector": 1.0}
    both = vf.one_model("x", slots)
    assert [s.model for s in both] == ["x", "y", "x"] and [s.weight for s in both] == [0.4, 0.3, 0.3]
    assert vf.scored(clip, found, "target", "id", both).first().scores == {"rvector": 1.0, "gemini": 1.0}
    with pytest.raises(ValueError, match="no strategy"):
        vf.verified(clip, F.lit(1.0), strategy="other")


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(3)
    for name, n, rate in (("a.wav", 500, 8000), ("b.wav", 300, 16_000), ("c.wav", 441, 44_100), ("none.wav", 0, 8000)):
        (tmp_path / name).write_bytes(wav_bytes(np.round(rng.uniform(-0.9, 0.9, n) * 32767) / 32767, rate))
    (tmp_path / "junk.wav").write_bytes(b"no sound")
    return tmp_path


def test_references_come_at_one_rate_whatever_their_own(spark, folder):
    rows = [("ann", 0, "a.wav"), ("ann", 1, "b.wav"), ("bob", 0, "c.wav"), ("bob", 1, "a.wav")]
    refs = spark.createDataFrame(rows, "target string, clip_no int, name string")
    got = {(r.target, r.clip_no): r.samples for r in rf.waves(rf.prepared(spark, refs, str(folder))).collect()}
    assert {k: len(v) for k, v in got.items()} == {("ann", 0): 1000, ("ann", 1): 300, ("bob", 0): 160, ("bob", 1): 1000}
    assert got["ann", 0] == got["bob", 1]
    stored = sf.header_of((folder / "b.wav").read_bytes())
    assert got["ann", 1] == pytest.approx(sf.mono((folder / "b.wav").read_bytes()[stored.at :], stored).tolist())


def test_references_that_cannot_be_used_raise(spark, folder):
    rows = [("ann", 0, "a.wav"), ("ann", 1, "none.wav"), ("bob", 0, "junk.wav"), ("bob", 1, "gone.wav")]
    refs = spark.createDataFrame(rows, "target string, clip_no int, name string")
    errors = {(r.target, r.clip_no): r.error for r in rf.checked(spark, refs, str(folder)).collect()}
    assert errors == {("ann", 0): None, ("ann", 1): "empty", ("bob", 0): "unreadable", ("bob", 1): "missing"}
    with pytest.raises(RuntimeError, match="3 reference clips cannot be used .*none.wav: empty"):
        rf.prepared(spark, refs, str(folder))
    assert {(r.target, r.clip_no) for r in rf.prepared(spark, refs, str(folder), strict=False).collect()} == {("ann", 0)}
