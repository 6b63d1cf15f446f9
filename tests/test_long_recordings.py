"""Operators whose work is one recording, one node or one file: spread over blocks, salts and ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import audio as au
from quillon.operators import catalog as ca
from quillon.plans import dataset as ds
from quillon.plans import shared


def plain_resample(x, source_rate, rate):
    n_out = round(len(x) * rate / source_rate)
    if not n_out:
        return []
    at = np.arange(n_out) * (len(x) / n_out)
    left = np.floor(at).astype(int)
    right = np.minimum(left + 1, len(x) - 1)
    return list(x[left] + (x[right] - x[left]) * (at - left))


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
@pytest.mark.parametrize("rates", [(16_000, 22_050), (44_100, 16_000), (8_000, 8_000)])
def test_resampling_in_any_blocks_equals_a_plain_loop(spark, block, rates):
    rng = np.random.default_rng(1)
    waves = {"a": rng.normal(size=200), "b": rng.normal(size=64), "c": rng.normal(size=1)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in waves.items() for i, v in enumerate(x)], "rec string, pos int, x double")
    got = au.resampled(rows.repartition(5), "rec", *rates, block=block).orderBy("rec", "pos").collect()
    for k, x in waves.items():
        own = [r for r in got if r.rec == k]
        want = plain_resample(x, *rates)
        assert [r.pos for r in own] == list(range(len(want)))
        assert [r.x for r in own] == pytest.approx(want, abs=1e-9)
    assert au.resampled(rows.limit(0), "rec", *rates).count() == 0


def test_samples_are_exchanged_by_recording_and_block(spark):
    rows = spark.createDataFrame([("a", 0, 1.0)], "rec string, pos int, x double")
    plan = au.resampled(rows, "rec", 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    own = [line for line in plan.splitlines() if "windowspecdefinition(" in line and "pos#" in line.split("windowspecdefinition(")[1]]
    assert own and all("block_" in line.split("windowspecdefinition(")[1] for line in own)


@pytest.mark.parametrize("rows", [1, 10, 10_000])
def test_closure_with_split_nodes_equals_a_walk(spark, monkeypatch, rows):
    monkeypatch.setattr(shared, "SPLIT_ROWS", rows)
    rng = np.random.default_rng(2)
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 70), rng.integers(0, 60, 70))} | {(100 + i, 99) for i in range(40)} | {(99, 98), (98, 97)}
    want = set()
    for start in {a for a, _ in edges}:
        seen, todo = set(), [start]
        while todo:
            here = todo.pop()
            for a, b in edges:
                if a == here and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(start, b) for b in seen}
    df = spark.createDataFrame([*edges, (1, None), (None, 1)], "node long, needs long")
    assert {(r.node, r.needs) for r in ca.closure(df).collect()} == want
    assert ca.closure(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="did not settle"):
        ca.closure(df, most_rounds=1)


def test_split_join_equals_a_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (None, 8)], "k long, a long")
    right = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 1), (None, 2)], "k long, b long")
    split = shared.split_join(left, right, "k", "a", rows=10)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, left.join(right, "k").select(*split.columns).collect()))


def test_lines_are_written_in_ranges_or_in_one_file(spark, tmp_path):
    rows = spark.range(1000).select(F.format_string("c%04d", "id").alias("clip_id"), F.col("id").cast("string").alias("value")).repartition(7)
    for name, one in (("many", False), ("one", True)):
        ds.write_lines(rows, str(tmp_path / name), one_file=one)
        parts = sorted((tmp_path / name).glob("part-*"))
        assert "".join(p.read_text() for p in parts).split() == [str(i) for i in range(1000)]
        assert not one or len(parts) == 1


def test_closure_joins_each_round_from_one_distance_only(spark, monkeypatch):
    """On a chain every pair but the edges is joined once, not once for each way to cut it."""
    joined, own = [], shared.split_join

    def counted(left, right, key, by):
        out = own(left, right, key, by)
        joined.append(out.count())
        return out

    monkeypatch.setattr(shared, "split_join", counted)
    chain = spark.range(1, 40).select(F.col("id").alias("node"), (F.col("id") - 1).alias("needs"))
    assert ca.closure(chain).count() == 39 * 40 // 2
    assert sum(joined) == 39 * 40 // 2 - 39
