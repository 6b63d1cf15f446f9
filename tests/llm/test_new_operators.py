"""Clustering, license scan and tokenizer alignment against brute force and their SQL, on small and awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_corpus_operators import awkward, docs_of

from quillon.llm import alignment, clustering, license_rules, licenses


def brute_clusters(rows, k, rounds):
    """Plain loops; rows are (id, components)."""
    kept = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows]
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"3:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), rows[j][1]))
    centroids = [list(kept[j][1]) for j in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    own = Counter()
    for _, n, d in found:
        own[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(str((i, n, d, own[n], sum(own.values()), digest[n])) for i, n, d in found)


def vectors(seed, n, components):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(components)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.3))) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (7, rows[3][1]), (None, rows[4][1]), (n + 2, [0.0] * components), (n + 3, [-0.5] * components)]
    return rows


@pytest.mark.parametrize("seed, n, k", [(1, 300, 8), (2, 40, 12), (3, 5, 8), (4, 30, 1), (5, 90, 2)])
def test_op11_equals_plain_loops(spark, seed, n, k):
    rows = vectors(seed, n, 6)
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 5 + [None]), (904, [1.0] * 5 + [float("nan")]), (905, [float("-inf")] * 6)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, cluster string, id int").repartition(3)
    got = clustering.cluster(table, k=k, rounds=10, components=6).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_clusters(rows, k, 10)


def test_op11_empty_and_too_great(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.cluster(spark.createDataFrame([], schema)).count() == 0
    assert clustering.cluster(spark.createDataFrame([(1, None)], schema)).count() == 0
    with pytest.raises(ValueError):
        clustering.cluster(spark.createDataFrame([(1, [1e6] * 64)], schema)).count()


def test_op11_bounds_spare_distances_and_the_ball_ends_scans():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (40, 16))
    points = (centres[rng.integers(0, 40, 5000)] + rng.integers(-60, 60, (5000, 16))).astype(np.int64)
    now = clustering.Centroids.of(points[:40].copy())
    state, before, asked = None, None, []
    real = clustering.squared

    def counting(a, b):
        asked[-1] += len(a)
        return real(a, b)

    clustering.squared = counting
    try:
        for _ in range(8):
            asked.append(0)
            state = clustering.advance(points, state, before, now)
            every = ((points[:, None] - now.points[None]) ** 2).sum(axis=2)
            assert (state[0] == every.argmin(axis=1)).all()
            moved = np.array([points[state[0] == c].sum(axis=0) // max((state[0] == c).sum(), 1) for c in range(40)])
            before, now = now.points, clustering.Centroids.of(moved)
    finally:
        clustering.squared = real
    assert asked[0] < 40 * 5000 and sum(asked[3:]) < 5 * 5000 * 40 * 0.1


LICENSES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under CC BY-NC 4.0.", "licensed under the GNU General Public License, version 3",
    "SPDX-License-Identifier: GPL-2.0-or-later", "public domain", "CC BY CC BY cc by-sa", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit license mit license", "the GPL v2 or later; see http://www.gnu.org/licenses/gpl-3.0.html", "MITLicense", "cc\nby", "MIT License", "Apache License", "All Rights Reserved",
]


def license_rows(seed=3):
    rng = random.Random(seed)
    filler = ["the", "of", "été", "日本", "a1", "cc", "by", "license", "mit", "gnu"]
    rows = [(i, text) for i, text in enumerate(LICENSES)]
    for i in range(60):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randint(0, 30))) if rng.random() < 0.6 else rng.choice(LICENSES) for _ in range(rng.randint(1, 12))]
        rows.append((100 + i, rng.choice([" ", ". ", "\n"]).join(parts)))
    return [*rows, (300, None), (301, ""), (302, " ,; "), (303, "mit license " * 30_000), (1, LICENSES[0]), (None, LICENSES[1])]


def brute_detections(text, chosen):
    """Every rule on single-spaced words, no keywords, every pair of detections compared."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    said = "".join(f" {w} " for w in words)
    found = []
    for n, (r, pattern) in enumerate(chosen):
        for m in pattern.finditer(said):
            start = said[: m.start()].count(" ") // 2
            found.append((start, start + m.group().count(" ") // 2, r.level, n, r.label, r.base))
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    kept = [not any(e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] for e in found[:i]) for i, d in enumerate(found)]
    return len(words), [(*d, k) for d, k in zip(found, kept)]


def test_op12_equals_all_rules_and_all_pairs(spark):
    rows = [r for r in license_rows() if r[0] != 303]
    chosen = [(r, re.compile(license_rules.spaced(r.pattern))) for r in license_rules.rules()]
    got = licenses.detect(docs_of(spark, rows)).collect()
    want = sorted(str((i, *brute_detections(t, chosen))) for i, t in rows)
    assert sorted(str((r.doc_id, r.n_words, [tuple(d) for d in r.detections])) for r in got) == want
    assert licenses.detect(docs_of(spark, [])).count() == 0


def test_op12_query_equals_sql_on_awkward_texts(spark, tmp_path):
    docs_of(spark, license_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    rows = licenses.op12_license_scan(spark, str(tmp_path)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[303].n_base, by_id[303].first_word, by_id[303].last_word, by_id[303].labels) == (30_000, 0, 59_998, "mit")
    assert by_id[2].base_labels == "cc-by" and by_id[2].labels == "cc-by,cc-by-nc-4" and by_id[2].score == 1.0
    assert by_id[300].n_words == 0 and by_id[300].first_word is None and by_id[300].labels == ""
    c = duckdb.connect()
    c.execute(f"create view documents as select doc_id, text from read_parquet('{tmp_path}/documents.parquet/*.parquet') where doc_id <> 303 or doc_id is null")
    names = sorted(rows[0].asDict())
    cursor = c.execute(licenses.OP12_SQL)
    at = [[x[0] for x in cursor.description].index(n) for n in names]
    assert sorted(str([r[n] for n in names]) for r in rows if r.doc_id != 303) == sorted(str([r[i] for i in at]) for r in cursor.fetchall())


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_op12_keywords_stand_in_whatever_their_rule_matches(data):
    rule = data.draw(st.sampled_from(license_rules.rules()))
    said = data.draw(st.from_regex(re.compile(license_rules.spaced(rule.pattern), re.ASCII), fullmatch=True))
    assert rule.keyword in said


def brute_alignment(rows, folder="/opt/tokenizers"):
    """Token by token with the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    letter = alignment.byte_of_letter()
    out, held, every = [], Counter(), []
    for i, text in rows:
        raw = f" {text}".encode() if text else b""
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spell_a = [bytes(letter[c] for c in a.id_to_token(t)) for t in ids_a]
        spell_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if b"".join(spell_a) != raw or b"".join(spell_b) != raw:
            ids_a, ids_b, spell_a, spell_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(s) for s in spell_a]).tolist(), np.cumsum([len(s) for s in spell_b]).tolist()
        groups, before = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(([t for t, e in zip(ids_a, ends_a) if before < e <= end], [t for t, e in zip(ids_b, ends_b) if before < e <= end]))
            before = end
        linked = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(linked))
        every.append(linked)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([i, len(ids_a), len(ids_b), len(groups), len(linked), said])
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(str((*o[:5], sum(held[p] == best[p[0]] for p in linked), sum(held[p] for p in linked), hashlib.sha256(o[5].encode()).hexdigest() if o[5] else "", o[5])) for o, linked in zip(out, every))


@pytest.mark.parametrize("chunk, plain", [(1 << 20, 4096), (300, 1)])
def test_op13_equals_token_by_token(spark, monkeypatch, chunk, plain):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "PLAIN_LINKS", plain)
    rows = [r if r[0] != 60 else (60, r[1][:3000]) for r in awkward(9)]
    rows += [(200, "<|endoftext|> <s> </s> <unk>"), (201, "a▁b"), (202, " " * 300 + "x" + "\n" * 40), (203, "ﬁ ½ é é ​ "), (204, "👩‍👩‍👧 नमस्ते עברית ไทย"), (205, "\x00\x01"), (7, "again"), (None, "no id"), (206, "=" * 257)]
    got = alignment.align_tokens(docs_of(spark, rows), with_groups=True).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_alignment(rows)
    assert alignment.align_tokens(docs_of(spark, [])).count() == 0


def test_op13_ranks_give_the_ids_of_the_merges():
    from tokenizers import Tokenizer

    pair = alignment.loaded(*(open(f"/opt/tokenizers/{f}", "rb").read() for f in (alignment.FILE_A, alignment.FILE_B)))
    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=80))
    def same(text):
        assert pair.encode_a.encode_ordinary(f" {text}") == a.encode(f" {text}", add_special_tokens=False).ids

    same()


def test_op13_groups_break_where_a_start_reaches_the_greatest_end():
    start, end = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 6, 3, 5, 6])
    assert alignment.coalesced(start, end).tolist() == [0, 0, 1, 0, 0, 1]
    assert pa.array(alignment.coalesced(start[:0], end[:0])).to_pylist() == []
