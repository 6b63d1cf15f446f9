"""The pipeline's stages against brute force, each on its own input; and awkward rows through all of them."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F
from quillon.llm import toxicity
from quillon.llm.decontaminate import decontaminate
from quillon.llm.frames import table
from quillon.llm.minhash import near_duplicates
from quillon.llm.mixing import mix, training_rows
from test_corpus_operators import WORD, brute_groups, brute_windows

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_do_what_their_operators_decide(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]

    model = toxicity.train(docs, table(spark, SF, "labels"))
    clean = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    a = stage["toxicity"](spark, docs, SF).persist()
    assert a.columns == columns and {r.doc_id for r in a.collect()} == clean and len(clean) > 100

    b = stage["near_dedup"](spark, a, SF).persist()
    groups = brute_groups([(r.doc_id, r.text) for r in a.collect()], 2)
    assert b.columns == columns and {r.doc_id for r in b.collect()} == {i for i, (_, c) in groups.items() if i == c}

    c = stage["decontamination"](spark, b, SF).persist()
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    held = brute_windows([(r.doc_id, r.text) for r in b.collect()], items)
    assert c.columns == columns and {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect()} - {i for i, s in held.items() if s}

    d = stage["mixing"](spark, c, SF).persist()
    assert d.columns == columns
    target = {r.source: r.target for r in mix(c).select("source", "target").distinct().collect()}
    took, source = defaultdict(int), {r.doc_id: r.source for r in c.collect()}
    whole, largest = {r.doc_id: r.text for r in c.collect()}, defaultdict(int)
    for r in c.collect():
        largest[r.source] = max(largest[r.source], len(WORD.findall(r.text)))
    for r in d.collect():
        took[r.source] += len(WORD.findall(r.text))
        assert r.text == whole[r.doc_id]
    assert all(abs(took[s] - target[s]) <= largest[s] / 2 + 1 for s in took) and max(Counter(r.doc_id for r in d.collect()).values()) <= 3
    assert set(took) <= set(source.values())

    e = stage["sharding"](spark, d, SF).persist()
    assert rows(e.select(columns)) == rows(d)
    slots = defaultdict(list)
    for r in e.collect():
        slots[r.shard].append(r.slot)
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_same_rows_twice(spark):
    one, two = cp.run(spark, SF), cp.run(spark, SF)
    pick = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert rows(one.select(pick)) == rows(two.select(pick)) and one.count() > 100


def test_awkward_rows_pass_through(spark):
    schema = table(spark, SF, "documents").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    docs = spark.createDataFrame([(None, "a b c", "en", None, 5), (None, None, None, None, None), (1, "", "en", "s", 0), (2, "x y z", "en", "s", 5), (2, "x y z", "en", "s", 5), (3, "x y z", None, "t", 5)], schema)
    for n, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, SF).persist()
        if n < 3:
            assert docs.count() == (6 if n == 0 else 4)
    assert docs.count() >= 1 and cp.STAGES[-1][1](spark, docs.limit(0).select("doc_id", "text"), SF).count() == 0


#: Names that the operators use for columns of their own.
INTERNAL = ["found", "slot_no", "slot_hash", "slot_size", "of_source", "of_slot", "slot_begin", "in_slot", "score", "predicted", "size", "source_size", "target", "taken", "first_word", "position", "slope", "similarity", "contaminated", "n_items", "item_ids", "take", "take_words", "take_position", "one", "digest", "digest_a", "bands", "root", "kept", "component_id", "n_shingles", "key", "node", "salt_", "salts_", "part", "rank", "bound", "level", "row", "doc", "input_0_", "toxic", "turn"]
LAST = ["virtual_slot", "shard", "slot", "map_version", "next_shard", "text_crc32"]


def test_columns_with_clashing_names_come_through(spark):
    docs = table(spark, SF, "documents").limit(60)
    more = {c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in INTERNAL + LAST}
    wide = docs.withColumns(more).persist()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.select("doc_id", *more).collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in more), name
    last = cp.STAGES[-1][1](spark, wide, SF)
    own = {"size", *LAST}
    rows = last.collect()
    assert len(rows) == 60 and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in more if c not in own)
    for shown in (toxicity.score(wide, toxicity.Model(*map(np.array, ([1], [0.5])))), decontaminate(wide, table(spark, SF, "benchmark")), training_rows(mix(wide)), near_duplicates(wide)):
        assert shown.count() > 0


def test_stages_on_empty_tables_and_awkward_texts(spark):
    docs = table(spark, SF, "documents")
    long = "word " * 200_000 + "tail"
    rows = [(1, long, "en", "s", 1), (2, long, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \t\n", "en", None, 3), (6, "one", "en", "s", 3), (6, "one", "en", "s", 3), (None, "one", "en", "s", 3)]
    few = spark.createDataFrame(rows, docs.schema)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, few, SF)
        assert out.count() > 0, name
        if name == "near_dedup":
            assert sorted((r.doc_id or 99) for r in out.collect()) == [1, 3, 4, 5, 6, 99]
        if name == "decontamination":
            assert out.count() == len(rows)
        if name == "sharding":
            assert out.count() == len(rows)
