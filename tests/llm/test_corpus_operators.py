"""Corpus operators against brute force, on small and awkward tables."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import anchors, chat, decontaminate, frames, line_dedup, media, minhash, mixing, sharding, substring_dedup, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, grp string, bucket int, score double, found string, shard string, rank string"


def docs_of(spark, rows):
    """Rows (doc_id, text[, source]) with columns whose names the operators use too."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "g", 7, 0.1, "f", "h", "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def awkward(seed=5, n=60):
    """Copies, shared passages, long and empty texts, odd white space, several scripts."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "añb", "été", "über", "x" * 40, "日本語", "a", "B", "b,"] + [f"w{i}" for i in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [say(25), say(60), say(9)]
    rows = []
    for i in range(n):
        kind = i % 10
        text = say(rng.randint(1, 80))
        if kind == 1:
            text = rows[-1][1]
        elif kind == 2:
            text = f"{say(10)} {rng.choice(passages)}\n{say(7)}\t\t{rng.choice(passages)}"
        elif kind == 3:
            text = "ab " * rng.randint(1, 90)
        elif kind == 4:
            text = rng.choice(["", "one", " \n ", "A b", "a B"])
        elif kind == 5:
            words = rows[0][1].split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((i, text))
    rows += [(n, say(4000)), (n + 1, None), (n + 2, rows[2][1])]
    return rows


def brute_words(rows, window):
    seen, out = set(), {}
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("hot, group_bytes", [(2048, 2 << 20), (2, 3000)])
def test_op1_removes_windows_that_start_earlier(spark, hot, group_bytes):
    rows = awkward()
    want = brute_words(rows, 20)
    got = substring_dedup.substring_dedup(docs_of(spark, rows), hot=hot, group_bytes=group_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)
    assert sum(r.n_removed for r in got) > 100


def test_op1_awkward_ids_and_empty_table(spark):
    run = " ".join(f"v{i}" for i in range(20))
    got = substring_dedup.substring_dedup(docs_of(spark, [(3, run), (3, run), (None, run), (1, "short")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 1, 0), (False, 3, 0), (False, 3, 20), (True, 0, 20)]
    assert substring_dedup.substring_dedup(docs_of(spark, [])).count() == 0


def brute_bytes(rows, window):
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        own = {raw[s : s + window] for s in range(len(raw) - window + 1)}
        for s in range(len(raw) - window + 1):
            if raw[s : s + window] in seen:
                gone[s : s + window] = b"\1" * window
        seen |= own
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


@pytest.mark.parametrize("hot, group_bytes", [(2048, 2 << 20), (2, 3000)])
def test_op9_removes_bytes_of_earlier_documents(spark, hot, group_bytes):
    rows = awkward(6)
    got = suffix_dedup.suffix_dedup(docs_of(spark, rows), hot=hot, group_bytes=group_bytes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got} == brute_bytes(rows, 50)
    same = suffix_dedup.suffix_dedup(docs_of(spark, [(3, "q" * 60), (3, "q" * 60), (None, "q" * 55), (4, "q" * 49)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in same) == [(False, 3, 0), (False, 3, 0), (False, 4, 0), (True, 0, 55)]
    assert suffix_dedup.suffix_dedup(docs_of(spark, [])).count() == 0


def test_op2_deletes_later_line_runs(spark):
    block = "l1\nl2\nl3\nl4"
    rows = [(1, f"a\n{block}\nb"), (2, f"c\nl2\nl3\nl4\nd\n{block}"), (3, "l1\nl2"), (4, None), (5, ""), (6, "x\nx\nx\nx"), (7, f"{block}"), (8, f"{block}")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got == {1: (6, 0, rows[0][1]), 2: (9, 7, "c\nd"), 3: (2, 0, "l1\nl2"), 4: (0, 0, ""), 5: (1, 0, ""), 6: (4, 3, "x"), 7: (4, 4, ""), 8: (4, 4, "")}
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def brute_lines(rows, least):
    """Longest earlier copy from each line on, by comparing with all earlier starts."""
    docs = [(i, text.split("\n")) for i, text in rows if text is not None]
    starts = [(d, s) for d in range(len(docs)) for s in range(len(docs[d][1]))]
    gone = {i: set() for i, _ in rows}
    for n, (d, s) in enumerate(starts):
        own, most = docs[d][1], 0
        for e, t in starts[:n]:
            other, k = docs[e][1], 0
            while s + k < len(own) and t + k < len(other) and own[s + k] == other[t + k]:
                k += 1
            most = max(most, k)
        if sum(len(WORD.findall(x)) for x in own[s : s + most]) >= least:
            gone[docs[d][0]] |= set(range(s, s + most))
    return {i: (0 if t is None else t.count("\n") + 1, len(gone[i]), "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i])) for i, t in rows}


def test_op2_measured_in_words_deletes_one_and_two_lines(spark):
    rng = random.Random(8)
    lines = ["", "", "a", "b c", "d e f", "g h i j", " ".join(["long"] * 9), "x\ty  z"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    rows += [(40, "one two three four five six"), (41, "one two three four five six"), (42, "p q r\n\n\n\n\ns t u"), (43, "z\np q r\n\n\n\n\ns t u\nz"), (44, None), (45, "")]
    for least in (1, 6, 25):
        want = brute_lines(rows, least)
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs_of(spark, rows), words=least).collect()}
        assert got == want
    assert brute_lines(rows, 6)[41] == (1, 1, "")
    twice = line_dedup.line_dedup(docs_of(spark, [(3, "a b\nc"), (3, "a b\nc"), (4, "a b"), (None, "a b\nc"), (None, "a b\nc")]), words=2).collect()
    assert sorted((r.doc_id or 9, r.n_removed) for r in twice) == [(3, 0), (3, 0), (4, 1), (9, 2), (9, 2)]
    assert line_dedup.line_dedup(docs_of(spark, []), words=6).count() == 0


def test_op3_learns_marked_words_and_never_uses_held_out_labels(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = " ".join(rng.choice(plain) for _ in range(30)) + (" you awful fool" if toxic else "")
        rows.append((i, text))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, 1, int(toxic) if not held else int(not toxic)))
    rows += [(1000, None), (1001, ""), (None, "you awful fool")]
    marked = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    got = toxicity.score(docs, toxicity.train(docs, marked)).collect()
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = [known[i].predicted == int(i % 5 == 0) for i in range(900)]
    assert sum(right) > 880
    assert known[1000].score == known[1001].score and known[1000].predicted == 0
    assert set(docs.columns) <= set(got[0].asDict())
    none = toxicity.score(docs, toxicity.train(docs, marked.limit(0))).first()
    assert 0 <= none.score <= 1


def test_op4_keeps_maximal_conversations(spark):
    say = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(texts)]
    rows = say(1, "a", "b") + say(2, "a", "b", "c") + say(3, "a", "b", "c") + say(4, "z") + say(5, "a", "x") + [(6, None, None, None, "x"), (None, 0, "user", "a", "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = {r.conv_id: r.rendered for r in chat.render(chat.collapse(chats)).collect()}
    assert set(got) == {2, 4, 5, 6}
    assert got[5] == "<|user|>\na<|end|>\n<|assistant|>\nx<|end|>\n"
    assert chat.render(chat.collapse(chats.limit(0))).count() == 0


def test_op5_round_trip_and_parsing(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 500), (5, "hello"), (None, "x")]
    got = media.document_media(docs_of(spark, rows)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r, stored = by_id[i], media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.decode(stored).tobytes() == payload
    assert by_id[1].feature == by_id[5].feature
    html = "<html><head><title>t</title></head><body><p>One <b>two</b></p><figure><img src='sha256:" + "a" * 64 + "'><figcaption>cap</figcaption></figure>three<script>no()</script><img src=b.png alt=pic></body></html>"
    parts = media.parse_html(html)
    assert [(p["kind"], p["text"] or p["reference"], p["caption"]) for p in parts] == [("text", "One two", None), ("media", "sha256:" + "a" * 64, "cap"), ("text", "three", None), ("media", "b.png", "pic")]
    assert [p["position"] for p in parts] == [0, 1, 2, 3] and media.parse_html(None) == [] and media.parse_html("<p") is not None
    assert media.document_media(docs_of(spark, [])).count() == 0
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    seen = media.resolve(media.sequences(pages, "page_id"), "page_id", media.media_features(media.media_rows(docs_of(spark, rows)))).orderBy("position").collect()
    assert [(r.page_id, r.position, r.caption, r.text_before) for r in seen] == [(1, 1, "cap", "One two"), (1, 3, "pic", "three")]


def test_op6_shards_evenly_and_grows_into_the_new_shard(spark, tmp_path):
    rows = awkward(9, 400) + [(None, "x"), (None, "x"), (7, "again")]
    docs = docs_of(spark, rows)
    got = sharding.shard(docs, shards=5).collect()
    assert len(got) == len(rows)
    slots, loads = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert set(slots) == set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(r.size for r in got)
    assert max(loads.values()) - min(loads.values()) <= biggest
    records = docs.select(sharding.slot_of().alias("virtual_slot"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size"))
    first = sharding.first_map(sharding.slot_loads(records), 5)
    sharding.store(first, str(tmp_path / "maps"))
    sharding.store(sharding.grow(sharding.stored(spark, str(tmp_path / "maps")), 5), str(tmp_path / "maps"))
    before, after = ({r.virtual_slot: r.shard for r in sharding.stored(spark, str(tmp_path / "maps"), v).collect()} for v in (1, 2))
    moved = [s for s in before if before[s] != after[s]]
    assert moved and all(after[s] == 5 for s in moved) and len(before) == len(after) == sharding.SLOTS
    assert sharding.shard(docs_of(spark, [])).count() == 0


def brute_windows(docs, items):
    def words(t):
        return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", (t or "").translate(LOWER))

    def bag(ws, k):
        out = defaultdict(int)
        for i in range(len(ws) - k + 1):
            out[tuple(ws[i : i + k])] += 1
        return out

    found = defaultdict(set)
    for i, text in docs:
        ws = words(text)
        for item, said in items:
            it = words(said)
            if not it or item is None:
                continue
            k = min(5, len(it))
            b = bag(it, k)
            for s in range(max(1, len(ws) - len(it) + 1)):
                a = bag(ws[s : s + len(it)], k)
                both = sum(min(n, b[g]) for g, n in a.items())
                total = sum(a.values()) + sum(b.values()) - both
                if both and both * 100 >= 80 * total:
                    found[i].add(item)
    return found


def test_op7_finds_items_whole_and_nearly(spark):
    rng = random.Random(4)
    say = lambda k: " ".join(f"w{rng.randrange(400)}" for _ in range(k))
    items = [(i, say(rng.randint(12, 50))) for i in range(12)] + [(12, "only three words"), (13, None), (14, " - "), (None, say(20))]
    docs = []
    for i in range(60):
        said = items[i % 12][1].split()
        if i % 4 == 1:
            said[len(said) // 2] = "changed"
        elif i % 4 == 2:
            said = said[: len(said) // 2]
        docs.append((i, f"{say(rng.randrange(30))}, {' '.join(said).upper() if i % 5 == 0 else ' '.join(said)}. {say(rng.randrange(30))}" if i % 4 != 3 else say(60)))
    docs += [(100, None), (101, ""), (102, "x Only (three) words!"), (103, " ".join(items[0][1].split()[1:])), (None, items[1][1])]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, found string")
    want = brute_windows(docs, items)
    for block_bytes in (8 << 20, 8000):
        got = {r.doc_id: set(r.item_ids) for r in decontaminate.decontaminate(docs_of(spark, docs), bench, block_bytes=block_bytes).collect()}
        assert got == {i: want.get(i, set()) for i, _ in docs}
    assert sum(map(bool, got.values())) > 15
    assert decontaminate.decontaminate(docs_of(spark, docs), bench.limit(0)).filter("contaminated").count() == 0


def test_op7_index_finds_all_fingerprints_within_the_radius_and_few_others():
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    for size in (1, 40, 4000):
        some, lengths = prints[:size], np.where(np.arange(size) % 4 == 3, 9, 7)
        lookup = decontaminate.Lookup.of(some, lengths)
        bits = [rng.choice(64, decontaminate.RADIUS, replace=False).astype(np.uint64) for _ in range(600)]
        asked = some[np.arange(600) % size] ^ np.array([np.bitwise_or.reduce(np.uint64(1) << b) for b in bits])
        row, item = lookup.candidates(asked, 7)
        found, within = set(zip(row.tolist(), item.tolist())), lookup.within(asked, 7)
        near = np.argwhere((np.bitwise_count(asked[:, None] ^ some) <= decontaminate.RADIUS) & (lengths == 7))
        assert sorted(zip(*(x.tolist() for x in within))) == sorted(map(tuple, near.tolist()))
        assert all((i, i % size) in found for i in range(600) if i % size % 4 != 3)
        if size > 1:
            assert (len(found) - 450) / 600 / (size * 3 / 4 - 1) < 0.12


def test_op7_query_path_asks_the_index_at_every_size(monkeypatch):
    """Few items or many: windows reach an item only as candidates of the index, which are few, and nearly all that resemble one are found."""
    rng = random.Random(12)
    for n in (3, 300):
        items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(30))) for i in range(n)]
        index = decontaminate.build_index(items, 5)
        asked, real = [], decontaminate.Lookup.candidates
        monkeypatch.setattr(decontaminate.Lookup, "candidates", lambda self, prints, length: asked.append((len(prints), real(self, prints, length))) or asked[-1][1])
        texts, want = [], []
        for i, text in items * (400 // n + 1):
            words = text.split()
            words[rng.choice([0, 1, 28, 29])] = "changed"
            texts.append(" ".join(["before", *words, "after"]).encode())
            want.append(i)
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        found = decontaminate.scan(index, data, offsets, 5, 80, {})
        hits = sum(i in {int(index.item_ids[j]) for j in f} for i, f in zip(want, found))
        assert hits / len(want) >= 0.9
        windows, met = sum(a for a, _ in asked), sum(len(x[0]) for _, x in asked)
        assert windows and met - windows < 0.12 * windows * n + windows
        monkeypatch.undo()


def test_op7_index_keeps_to_its_bound():
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**5)}" for _ in range(rng.choice([3, 40, 300])))) for i in range(3000)]
    index = decontaminate.build_index(rows, 5)
    held = sum(len(pickle.dumps(x)) for x in (index.item_ids, index.start, index.shingles, index.times, index.lookup, index.known))
    assert held <= sum(len(t) * decontaminate.TEXT_BYTES + decontaminate.ITEM_BYTES for _, t in rows)


def test_op7_recall_at_the_bound():
    """Pairs of a similarity from 0.8 to 0.9: nearly all have fingerprints within the radius."""
    rng = random.Random(10)
    near = n = 0
    for _ in range(2000):
        grams = np.array([rng.getrandbits(63) for _ in range(rng.randint(20, 60))], np.uint64)
        other = grams.copy()
        changed = max(1, int(len(grams) * rng.uniform(0.06, 0.11)))
        other[:changed] = [rng.getrandbits(63) for _ in range(changed)]
        if (len(grams) - changed) / (len(grams) + changed) >= 0.8:
            n += 1
            near += int(np.bitwise_count(decontaminate.simhash(grams[None, :])[0] ^ decontaminate.simhash(other[None, :])[0])) <= decontaminate.RADIUS
    assert n > 1500 and near / n > 0.985


def test_op8_targets_and_takes(spark):
    rng = random.Random(3)
    sources = ["b", "a", None, "Z", "é"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), sources[min(i % 7, 4)]) for i in range(300)] + [(900, None, "a"), (901, "x y", "tiny"), (901, "x y", "tiny"), (None, "q", "b")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(sizes)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    repeats = mixing.training_rows(mixing.mix(docs_of(spark, rows))).collect()
    assert sum(r.take_words for r in repeats) == sum(taken.values())
    assert [r.take_position for r in repeats] == sorted(r.take_position for r in repeats) and all(0 <= r.take_position <= 1 for r in repeats)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None, "a")])).first().taken == 0


def brute_groups(rows, shingle):
    sets = {}
    for i, text in rows:
        ws = WORD.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(ws[j : j + shingle]) for j in range(len(ws) - shingle + 1)) if len(ws) >= shingle else frozenset([tuple(ws)] if ws else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small", [32, 1])
def test_op10_components_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = awkward(7)
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows), shingle=2).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_groups(rows, 2).items()}
    assert len({c for _, c, _ in got.values()}) > 20


def test_op10_crowded_keys_are_split_and_lose_no_pair(spark, monkeypatch):
    rows = [(7, i, 40, i % 23, 1 + i % 9) for i in range(180)] + [(8, i, 40, i, 1) for i in range(5)] + [(9, i, 40, 3, 1) for i in range(20)]
    entries = frames.cut(spark.createDataFrame(rows, minhash._ENTRIES))
    opened = frames.cut(minhash._open(entries, entries))
    want = set()
    for key in (7, 8, 9):
        own = [r for r in rows if r[0] == key]
        roots = [r[3] for r in own]
        main = max(set(roots), key=lambda x: (roots.count(x), x))
        for _, x, n, root, nth in own:
            if root != main:
                want |= {(min(x, y), max(x, y)) for _, y, m, other, at in own if other != root and (min(n - nth, m - at) + 1) * 180 >= (n + m) * 80}
    assert {tuple(r) for r in minhash._crossing(opened, 80).collect()} == want
    monkeypatch.setattr(frames, "HOT_ROWS", 50)
    split = minhash._crossing(opened, 80, opened)
    assert {tuple(r) for r in split.collect()} == want and split.count() == minhash._crossing(opened, 80).count()
    joins = [line for line in split._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert any("salt_" in line for line in joins)


def test_op10_awkward_ids_and_empty_table(spark):
    got = minhash.near_duplicates(docs_of(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (9, "A B  c"), (4, None), (5, "")]), shingle=2).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(False, 2, 2, True), (False, 2, 2, True), (False, 4, 4, True), (False, 5, 5, True), (False, 9, 2, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_op10_rarest_shingles_are_counted_in_groups_that_follow_the_data(spark, monkeypatch):
    rng = random.Random(4)
    sets = [(i, sorted(rng.sample(range(-40, 40), 12) + [1000 + i, 99])) for i in range(300)]
    nodes = spark.createDataFrame([(i, len(s), i % 7) for i, s in sets], "node long, n_shingles long, root long")
    often = defaultdict(int)
    for _, s in sets:
        for x in s:
            often[x] += 1
    want = []
    for i, s in sets:
        first = sorted((often[x], x) for x in s)[: len(s) - -(-len(s) * 80 // 100) + 1]
        want += [(x, i, len(s), i % 7, k + 1) for k, (n, x) in enumerate(first) if n > 1]
    seen, deal = [], minhash.parts_for
    monkeypatch.setattr(minhash, "parts_for", lambda *a, **k: seen.append(deal(*a, **k)) or seen[-1])
    for each in (1 << 20, 50):
        got = minhash._rarest(nodes, spark.createDataFrame(sets, "doc_id long, shingles array<long>"), 80, each)
        assert sorted(tuple(r) for r in got.select("key", "node", "n_shingles", "root", "nth").collect()) == sorted(want)
    assert seen == [32, 84]
    # a shingle of all classes reaches its bucket once for each group, not for each class
    sent = minhash._token_counter(minhash._token_sender(1)((type("K", (), {"as_py": lambda self: 5})(),), pa.table({"shingles": pa.array([[1, 2], [1, 3], [1, 4]], pa.list_(pa.int64()))})))
    assert sent.to_pydict() == {"grp": [5], "tokens": [[1]], "often": [[3]]}


def test_op2_repeated_rows_cost_in_proportion(spark):
    """Repeated rows are one document: names are one row a place, however often a row was given."""
    text = "\n".join(f"line {i} {i * 7}" for i in range(4))
    docs = spark.createDataFrame([(1, text)] * 200 + [(2, text)] * 200, "doc_id long, text string")
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), "text")
    starts = line_dedup.repeated_runs(keyed)
    assert sorted((r.doc, r.line) for r in starts.collect()) == [(2, 0), (2, 1)]
    got = line_dedup.line_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0)] * 200 + [(2, 4)] * 200


def duck_rows(sql, **tables):
    import duckdb

    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame.toArrow())
    cursor = c.execute(sql)
    return [x[0] for x in cursor.description], cursor.fetchall()


def same_rows(df, sql, **tables):
    names, want = duck_rows(sql, **tables)
    got = df.select(names).collect()
    shown = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert shown(got) == shown(want) and len(got) > 0


def test_sql_of_op2_op4_and_op8_on_awkward_tables(spark):
    rows = [(i, t) for i, t in awkward(6, 80)] + [(500, "a\n\n\nb"), (501, "\n\n\n"), (502, "a\n\n\nb\nc")]
    docs = docs_of(spark, rows).select("doc_id", "text", "source")
    done = line_dedup.line_dedup(docs)
    same_rows(done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")), line_dedup.OP2_SQL, documents=docs)
    rng = random.Random(12)
    turns = []
    for c in range(60):
        said = turns and rng.choice([[t for t in turns if t[0] == rng.randrange(c)], []]) or []
        texts = [t[3] for t in said] + [rng.choice(["a", "b", "", None]) for _ in range(rng.randint(0 if said else 1, 3))]
        turns += [(c, i if rng.random() < 0.9 else None, rng.choice(["user", None]) if rng.random() < 0.1 else "user", t) for i, t in enumerate(texts)]
    turns += turns[:4] + [(None, 0, "user", "a")]
    chats = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    same_rows(chat.render(chat.collapse(chats)), chat.OP4_SQL, conversations=chats)
    mixed = docs_of(spark, [(i, t, ["b", "a", None, "Z", "é"][i % 7 % 5]) for i, t in rows] + [(None, "x y", "a"), (None, "y z q", "a"), (3, "other text", "b")]).select("doc_id", "text", "source")
    got = mixing.mix(mixed).select("doc_id", "size", "source_size", "target", "taken", "position")
    same_rows(got, mixing.OP8_SQL, documents=mixed)


def test_hot_keys_are_split(spark, monkeypatch):
    """One key with most rows: its rows are dealt over many tasks, and nothing is lost."""
    monkeypatch.setattr(frames, "HOT_ROWS", 100)
    key = F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 100 == 0, F.lit(None)).otherwise(F.col("id"))).otherwise(0)
    rows = frames.cut(spark.range(5000).select(key.cast("int").alias("k"), "id"))
    hot = frames._hot(rows.groupBy("k").agg(F.count("*").alias("rows_")), ["k"], 5000)
    assert [tuple(r) for r in hot.collect()] == [(0, frames.SALTS)]
    salts = frames._salted(rows, ["k"], ["id"], hot).groupBy("k").agg(F.count_distinct("salt_").alias("n")).collect()
    assert {r.n for r in salts if r.k == 0} == {frames.SALTS} and {r.n for r in salts if r.k} == {1} and {r.n > 30 for r in salts if r.k is None} == {True}
    got = frames.with_totals(rows, ["k"], ["id"], F.count("*").alias("n"), F.min("id").alias("least"), having="n > 1")
    assert {(r.k, r.n, r.least) for r in got.select("k", "n", "least").distinct().collect()} == {(0, 4500, 1)} and got.count() == 4500
    lookup = spark.createDataFrame([(0, "zero"), (10, "ten")], "k int, name string")
    assert frames.attached(rows, lookup, ["k"], ["id"]).count() == 4501
    left = frames.attached(rows, lookup, ["k"], ["id"], how="left")
    assert left.count() == 5000 and left.filter("name is null").count() == 499
    monkeypatch.setattr(frames, "MOST_HOT", 1)
    assert frames._hot(rows.groupBy("k").agg(F.count("*").alias("rows_")), ["k"], 5000).count() == 0


def test_repeated_windows_exchange_grows_in_proportion():
    rows = lambda size: (size / anchors.group_size(size)) * (size / min(anchors.group_size(size) * anchors.GROUPS_A_BUCKET, anchors.MOST_BUCKET))
    assert rows(850 << 20) / rows(170 << 20) == pytest.approx(5, rel=0.02)


def test_op3_learner_equals_a_plain_loop():
    """FTRL-proximal, one document and one coordinate at a time."""
    rng = random.Random(3)
    settings = toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.7, l2=0.3)
    documents = [sorted(rng.sample(range(40), rng.randint(1, 12))) + [1 << toxicity.BITS] for _ in range(300)]
    labels = [int(3 in d or rng.random() < 0.1) for d in documents]
    z, n = defaultdict(float), defaultdict(float)
    for d, y in zip(documents, labels, strict=True):
        w = {i: 0.0 if abs(z[i]) <= settings.l1 else ((settings.l1 if z[i] > 0 else -settings.l1) - z[i]) / ((settings.beta + n[i] ** 0.5) / settings.alpha + settings.l2) for i in d}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in d:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / settings.alpha * w[i]
            n[i] += g * g
    none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    idx, zs, ns = toxicity._learn([np.array(d, np.int32) for d in documents], np.array(labels, float), settings, none)
    assert idx.tolist() == sorted(i for i in z if abs(z[i]) > settings.l1) and 3 in idx.tolist()
    assert zs == pytest.approx([z[i] for i in idx.tolist()]) and ns == pytest.approx([n[i] for i in idx.tolist()])


def test_op5_feature_equals_a_plain_loop():
    rng = random.Random(4)
    for height in (1, 3, 8, 13):
        samples = np.array([[rng.randrange(256) for _ in range(media.ROW)] for _ in range(height)], np.uint8)
        bits = []
        for r in range(8):
            top, end = (0, height) if height < 8 else (r * height // 8, (r + 1) * height // 8)
            sums = [sum(int(x) for row in samples[top:end] for x in row[c * media.ROW // 9 : (c + 1) * media.ROW // 9]) for c in range(9)]
            bits += [int(a < b) for a, b in zip(sums, sums[1:], strict=False)]
        assert media.difference_hash(samples) == f"{int(''.join(map(str, bits)), 2):016x}"


def test_pages_are_read_in_order(spark):
    got = media.page_sequences(spark, "/root/testdata/sf0.001")
    html = {r.page_id: r.html for r in frames.table(spark, "/root/testdata/sf0.001", "pages").collect()}
    rows = got.collect()
    assert len(rows) == len(html)
    for r in rows:
        parts = media.parse_html(html[r.page_id])
        said = "\n".join(p["text"] for p in parts if p["kind"] == "text")
        assert (r.n_parts, r.n_media, r.text_sha256) == (len(parts), sum(p["kind"] == "media" for p in parts), hashlib.sha256(said.encode()).hexdigest())


def test_op6_missing_and_repeated_ids_spread(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i} " + "x" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    got = sharding.shard(docs, shards=8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    loads = [r.n for r in got]
    assert len(loads) == 8 and max(loads) - min(loads) <= 200
    moved = sharding.shard(docs, shards=8).filter("next_shard <> shard")
    assert {r.next_shard for r in moved.select("next_shard").distinct().collect()} == {8} and 0 < moved.count() < 1000


def brute_map(loads, shards):
    """Greedy over (bytes, slot), heaviest first, to the lightest shard; ties to the smaller shard."""
    held, out = [0] * shards, {}
    for size, slot in sorted(((n, s) for s, n in loads.items()), reverse=True):
        out[slot] = held.index(min(held))
        held[out[slot]] += size
    return out


def brute_grown(loads, placed, shards):
    """Every shard gives up its lightest slots while it stays at or above the new mean."""
    mean, out = sum(loads.values()) / (shards + 1), dict(placed)
    for shard in range(shards):
        own = sorted((loads[s], s) for s in placed if placed[s] == shard)
        left = sum(n for n, _ in own)
        for n, s in own:
            left -= n
            if left < mean:
                break
            if n:
                out[s] = shards
    return out


@pytest.mark.parametrize("copies", [0, 4000])
def test_op6_equals_a_greedy_over_slot_sums(spark, copies):
    rng = random.Random(copies)
    rows = [(i, "w" * rng.randint(0, 60)) for i in range(16_000)] + [(77, "again and again")] * copies
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=6).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    loads = {s: 0 for s in range(sharding.SLOTS)}
    for r in got:
        loads[r.virtual_slot] += r.size
    now = brute_map(loads, 6)
    later = brute_grown(loads, now, 6)
    assert all(r.shard == now[r.virtual_slot] and r.next_shard == later[r.virtual_slot] for r in got)
    numbered = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.virtual_slot, r.doc_id, r.size)):
        numbered[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in numbered.values())
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(6)]
    assert max(sizes) <= 1.1 * min(sizes)
    if not copies:
        assert all(numbered[s] == sorted(numbered[s]) for s in numbered)
