"""Repeated windows across a corpus: minimiser anchors, super-k-mer segments, removal masks.

The two exact window-dedup operators share this plan; they differ in what a
symbol is (a word, a byte) and in how a bucket finds equal windows.

1. Documents are dealt into groups of a few megabytes.  Groups and buckets grow
   with the square root of the text, so that the rows exchanged between them (one
   for each group and bucket) grow in proportion to it; from about 16 GB of text
   on their bounds hold, and rows grow until each holds one string.  Each window of ``window``
   symbols has one *anchor*: its k-gram with the least hash.  Consecutive windows
   with the same anchor form a run.  A group sends the distinct anchor hashes it
   has, with counts, to hash buckets.
2. A bucket sends back the anchors that occur at least twice anywhere.  Equal
   windows have equal anchors, so all other windows are known to be unique.
   Anchors with very many occurrences are marked *hot*.
3. Each group packs the runs of shared anchors (super-k-mers) as strings, one
   copy of each distinct string, to the bucket of the anchor.  Runs of hot
   anchors are cut into single windows, dealt by the hash of the window, so that
   no anchor fills a bucket; inside a group equal windows travel once.
4. The bucket decides exactly, on the symbols, which windows start earlier too.
5. The covered symbols come back to the group, which removes them.

The exchange of texts by group is the same in steps 1, 3 and 5, and Spark reuses it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textnp as tn
from quillon.llm.frames import parts_for, total_bytes

#: Text of a group where there is 1 GiB of text in all.
GROUP_BYTES = 2 << 20
#: Bounds of a group's text, so that a task's memory is bounded.
LEAST_GROUP, MOST_GROUP = 1 << 19, 16 << 20
#: Text for each bucket: in groups, and at most.
GROUPS_A_BUCKET = 4
MOST_BUCKET = 16 << 20
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Spec:
    """What a window is, and which equal window counts as earlier."""

    window: int
    gram: int
    by_word: bool
    #: Another place in the same document counts as earlier.
    within_document: bool
    #: From so many occurrences on an anchor's windows are dealt one by one.
    hot: int = 2048


class Group:
    """The documents of one group, sorted by id (ties by text), nulls last."""

    def __init__(self, docs: pa.Table):
        ids = docs["doc_id"].combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        keys = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        if len(np.unique(keys)) < len(keys):
            texts = docs["text"].to_pylist()
            order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], texts[i] is not None, texts[i] or "")), np.int64)
        docs = docs.take(pa.array(order))
        self.null = ids.is_null().to_numpy(zero_copy_only=False)[order]
        self.ids = keys[order]
        self.data, self.offsets = tn.binary_buffers(docs["text"])


@dataclass
class Runs:
    """Super-k-mers of some documents: symbol positions in the chunk."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray
    document: np.ndarray


@dataclass
class Chunk:
    """Documents low..high of a group as symbols."""

    low: int
    high: int
    data: np.ndarray
    values: np.ndarray
    #: First symbol of each document, and the end.
    start: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def chunked(group: Group, spec: Spec):
    """The symbols of a group, chunk by chunk."""
    for low, high in tn.chunks(group.offsets):
        data = group.data[group.offsets[low] : group.offsets[high]]
        offsets = group.offsets[low : high + 1] - group.offsets[low]
        if spec.by_word:
            begin, end, start = tn.words(data, offsets)
            yield Chunk(low, high, data, tn.span_hashes(data, begin, end), start, begin, end)
        else:
            places = np.arange(len(data) + 1)
            yield Chunk(low, high, data, tn.byte_values(data), offsets, places[:-1], places[1:])


def runs_of(chunk: Chunk, spec: Spec) -> Runs:
    """The anchors of all windows of a chunk, as runs of windows that share one."""
    grams = tn.gram_hashes(chunk.values, spec.gram)
    width = spec.window - spec.gram + 1
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, np.uint64), none)
    bits = np.uint64(max(20, int(len(grams)).bit_length()))
    # the place in the low bits: ties go to the leftmost, and the place of the minimum comes along
    place = tn.sliding_min(((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64), width)
    place &= (np.uint64(1) << bits) - np.uint64(1)
    length = np.maximum(np.diff(chunk.start) - spec.window + 1, 0)
    windows = tn.ranges(chunk.start[:-1], length)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, np.uint64), none)
    anchor = place[windows].astype(np.int64)
    document = np.repeat(np.arange(len(length)), length)
    new = np.empty(len(windows), bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[1:] |= document[1:] != document[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(windows)) - 1
    return Runs(windows[at], windows[last], anchor[at], grams[anchor[at]], document[at])


ANCHORS = "bucket int, grp int, hashes binary, counts array<int>"
SHARED = "grp int, shared array<long>, hot array<long>"
SEGMENTS = "bucket int, grp int, strings binary, known binary"
COVERED = "grp int, covered binary"

#: Types of the arrays in SEGMENTS.strings, SEGMENTS.known and COVERED.covered.
_STRINGS = (np.uint8, np.int32, np.int16, np.int32, np.int32, np.int64, np.int32, np.int32)
_RANGES = (np.int32, np.int32, np.int32)
_NAME_BYTES = 6


def name_of(hashes: np.ndarray) -> np.ndarray:
    """48 bits of an anchor's hash: enough to find out which occur once."""
    return tn.mix(hashes) >> np.uint64(64 - 8 * _NAME_BYTES)


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (tn.mix(names) % np.uint64(buckets)).astype(np.int32)


def split_by(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by key, the distinct keys, and how many rows each has."""
    order = np.argsort(key, kind="stable")
    kinds, counts = np.unique(key, return_counts=True)
    return order, kinds, counts


def anchor_sender(spec: Spec, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Step 1: a group's distinct anchors and their counts, by bucket."""

    def send(key: tuple, docs: pa.Table) -> pa.Table:
        group = Group(docs)
        found = [name_of(runs_of(c, spec).hash) for c in chunked(group, spec)]
        names, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        order, kinds, sizes = split_by(bucket_of(names, buckets))
        raw = np.ascontiguousarray(names[order]).view(np.uint8).reshape(-1, 8)[:, :_NAME_BYTES]
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "bucket": pa.array(kinds, pa.int32()),
                "grp": pa.array(np.full(len(kinds), key[0].as_py()), pa.int32()),
                "hashes": pa.array([raw[e - n : e].tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary()),
                "counts": tn.list_column(np.minimum(counts[order], 1 << 30).astype(np.int32), sizes, pa.int32()),
            }
        )

    return send


def anchor_counter(spec: Spec) -> Callable[[pa.Table], pa.Table]:
    """Step 2: which of a bucket's anchors occur at least twice, for each group that has them."""

    def count(rows: pa.Table) -> pa.Table:
        raw, _ = tn.binary_buffers(rows["hashes"])
        names = np.zeros((len(raw) // _NAME_BYTES, 8), np.uint8)
        names[:, :_NAME_BYTES] = raw.reshape(-1, _NAME_BYTES)
        names = names.view(np.int64).ravel()
        counts, sizes = tn.flat(rows["counts"])
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
        total = np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else at
        total = np.repeat(total, np.diff(np.append(at, len(order))))
        keep = total >= 2
        picked, hot = order[keep], total[keep] >= spec.hot
        back = np.argsort(row[picked], kind="stable")
        picked, hot = picked[back], hot[back]
        n = len(sizes)
        return pa.table(
            {
                "grp": rows["grp"],
                "shared": tn.list_column(names[picked[~hot]], np.bincount(row[picked[~hot]], minlength=n), pa.int64()),
                "hot": tn.list_column(names[picked[hot]], np.bincount(row[picked[hot]], minlength=n), pa.int64()),
            }
        )

    return count


@dataclass
class Strings:
    """Runs of a group whose anchor is shared, with their text."""

    name: np.ndarray
    #: Anchor's place in the run; -1 for a single window of a hot anchor.
    offset: np.ndarray
    content: np.ndarray
    slot: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray
    length: np.ndarray
    data: np.ndarray
    #: Ranges (slot, begin, end) of windows that start earlier in the chunk too.
    known: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def merged(slot: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that start at neighbouring places as ranges of symbols."""
    order = np.lexsort((place, slot))
    slot, place = slot[order], place[order]
    new = np.append(True, (slot[1:] != slot[:-1]) | (place[1:] != place[:-1] + 1))[: len(slot)]
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(slot)) - 1
    return slot[at], place[at], place[stop] + window if len(at) else place[at]


def single_windows(group: Group, spec: Spec, chunk: Chunk, data: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of hot anchors a chunk has to send (indices), and which of them start earlier too.

    Equal windows of a chunk are sent with the places in their first document only.
    """
    content = tn.gram_hashes(chunk.values, spec.window)[starts]
    order = np.lexsort((starts, content))
    fresh = np.append(True, content[order][1:] != content[order][:-1])
    head = order[fresh][np.cumsum(fresh) - 1]
    at, size = begin[starts], end[starts + spec.window - 1] - begin[starts]
    again = np.flatnonzero(~fresh)
    if not tn.equal_spans(data, at[order[again]], size[order[again]], at[head[again]], size[head[again]]):
        return np.arange(len(starts)), starts[:0]
    stays = fresh if spec.within_document else group.ids[slots[order]] == group.ids[slots[head]]
    return order[stays], order[~stays]


def spaced(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk, each followed by one space: bytes, starts and ends."""
    size = chunk.end - chunk.begin
    padded = np.append(chunk.data, np.uint8(32))
    data = padded[tn.ranges(chunk.begin, size + 1)]
    begin = np.cumsum(size + 1) - size - 1
    data[begin + size] = 32
    return data, begin, begin + size


def strings_of(group: Group, spec: Spec, shared: np.ndarray, hot: np.ndarray) -> Strings:
    """All strings of a group that a bucket has to see."""
    parts, base, known = [], 0, []
    for chunk in chunked(group, spec) if len(shared) or len(hot) else ():
        runs = runs_of(chunk, spec)
        name = name_of(runs.hash).view(np.int64)
        take, one = np.flatnonzero(np.isin(name, shared)), np.flatnonzero(np.isin(name, hot))
        if not len(take) and not len(one):
            continue
        data, begin, end = spaced(chunk) if spec.by_word else (chunk.data, chunk.begin, chunk.end)
        times = (runs.last - runs.first + 1)[one]
        single, owner = tn.ranges(runs.first[one], times), np.repeat(runs.document[one], times)
        if len(single):
            sent, earlier = single_windows(group, spec, chunk, data, begin, end, single, owner + chunk.low)
            known.append(merged(owner[earlier] + chunk.low, single[earlier] - chunk.start[owner[earlier]], spec.window))
            single, owner = single[sent], owner[sent]
        first = np.concatenate([runs.first[take], single])
        stop = np.concatenate([runs.last[take], single]) + spec.window
        document = np.concatenate([runs.document[take], owner])
        offset = np.concatenate([runs.anchor[take] - runs.first[take], np.full(len(single), -1)])
        content = tn.value_span_hashes(chunk.values, first, stop)
        names = np.concatenate([name[take], name_of(content[len(take) :]).view(np.int64)])
        place = first - chunk.start[document]
        at, size = begin[first], end[stop - 1] - begin[first]
        raw = tn.take_spans(data, at, size)
        parts.append((names, offset, content, document + chunk.low, place, place + (stop - first), base + np.cumsum(size) - size, size, raw))
        base += len(raw)
    if not parts:
        none = np.zeros(0, np.int64)
        return Strings(none, none, none.view(np.uint64), none, none, none, none, none, none.astype(np.uint8), known)
    return Strings(*[np.concatenate(x) for x in zip(*parts, strict=True)], known)


def distinct(s: Strings) -> np.ndarray:
    """A key for each string: equal anchors, places and bytes, equal key."""
    key = tn.mix(s.content + tn.mix(s.name.view(np.uint64) * np.uint64(2) + (s.offset + 1).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    left, right = order[same - 1], order[same]
    equal = tn.equal_spans(s.data, s.at[left], s.length[left], s.at[right], s.length[right])
    if equal:
        return key
    # two texts with one hash: key the strings by what they are
    raw, known = s.data.tobytes(), {}
    return np.array([known.setdefault((n, o, raw[a : a + z]), len(known)) for n, o, a, z in zip(s.name.tolist(), s.offset.tolist(), s.at.tolist(), s.length.tolist(), strict=True)], np.uint64)


def segment_sender(spec: Spec, buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Step 3: the distinct strings of the runs whose anchor is shared, by bucket.

    A string goes with its places in the group's first document that has it.  Its
    windows are known to start earlier for all other places.
    """

    def send(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        group = Group(docs)
        s = strings_of(group, spec, np.sort(tn.flat(shared["shared"])[0]), np.sort(tn.flat(shared["hot"])[0]))
        keys = distinct(s)
        order = np.lexsort((s.begin, s.slot, keys))
        fresh = np.append(True, keys[order][1:] != keys[order][:-1]) if len(order) else np.zeros(0, bool)
        head = order[fresh]
        string = np.cumsum(fresh) - 1
        goes = fresh.copy() if spec.within_document else group.ids[s.slot[order]] == group.ids[s.slot[head]][string]
        rest = order[~goes]
        known = tn.pack(*(np.concatenate(x).astype(np.int32) for x in zip((s.slot[rest], s.begin[rest], s.end[rest]), *s.known, strict=True)))
        spot, of = order[goes], string[goes]
        where = bucket_of(s.name[head].view(np.uint64), buckets)
        by, kinds, sizes = split_by(where)
        turn = np.empty(len(by), np.int64)
        turn[by] = np.arange(len(by))
        again = np.argsort(turn[of], kind="stable")
        spot, of = spot[again], turn[of][again]
        cuts = np.append(0, np.cumsum(sizes))
        spots = np.searchsorted(of, cuts)
        head = head[by]
        out = []
        for a, b, x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), spots[:-1].tolist(), spots[1:].tolist(), strict=True):
            mine, places = head[a:b], spot[x:y]
            slots, inverse = np.unique(s.slot[places], return_inverse=True)
            text = tn.take_spans(s.data, s.at[mine], s.length[mine])
            out.append(tn.pack(text, s.length[mine].astype(np.int32), s.offset[mine].astype(np.int16), np.bincount(of[x:y] - a, minlength=b - a).astype(np.int32), slots.astype(np.int32), group.ids[slots], inverse.astype(np.int32), s.begin[places].astype(np.int32)))
        kinds = kinds.tolist()
        if len(rest) and not kinds:
            raise AssertionError("a repeated string has a first place")
        return pa.table(
            {
                "bucket": pa.array(kinds, pa.int32()),
                "grp": pa.array([key[0].as_py()] * len(kinds), pa.int32()),
                "strings": pa.array(out, pa.binary()),
                "known": pa.array([known] * bool(kinds) + [None] * (len(kinds) - 1) if kinds else [], pa.binary()),
            }
        )

    return send


@dataclass
class Bucket:
    """The strings of one bucket; `first` says where each string's places begin."""

    data: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    #: Of each place: row of the bucket, slot in its group, document, place in it.
    row: np.ndarray
    slot: np.ndarray
    doc: np.ndarray
    place: np.ndarray


def unpacked(rows: pa.Table) -> Bucket:
    """The rows that met in a bucket; sort them by group, so that ties fall the same way whenever a task runs again."""
    parts = []
    for i, packed in enumerate(rows["strings"].to_pylist()):
        text, length, offset, times, slots, ids, inverse, place = tn.unpack(packed, *_STRINGS)
        parts.append((text, length, offset, times, np.full(len(place), i), slots[inverse], ids[inverse], place))
    text, length, offset, times, row, slot, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    length = length.astype(np.int64)
    return Bucket(text, np.cumsum(length) - length, length, offset.astype(np.int64), np.append(0, np.cumsum(times)).astype(np.int64), row, slot, doc, place.astype(np.int64))


def covered_rows(rows: pa.Table, bucket: Bucket, spot: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """Covered ranges by group: those found (for place `spot`) and those known before."""
    row = bucket.row[spot]
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(rows.num_rows + 1))
    slot, begin, end = (x[order].astype(np.int32) for x in (bucket.slot[spot], begin, end))
    groups, known = rows["grp"].to_pylist(), rows["known"].to_pylist()
    found = [(g, tn.pack(slot[a:b], begin[a:b], end[a:b])) for g, a, b in zip(groups, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
    found += [(g, k) for g, k in zip(groups, known, strict=True) if k is not None]
    return pa.table({"grp": pa.array([g for g, _ in found], pa.int32()), "covered": pa.array([c for _, c in found], pa.binary())})


def masks(group: Group, covered: pa.Table, spec: Spec):
    """Step 5: each chunk of a group with the mask of its covered symbols."""
    parts = [tn.unpack(c, *_RANGES) for c in covered["covered"].to_pylist()]
    slot, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3
    order = np.argsort(slot, kind="stable")
    slot, begin, end = slot[order], begin[order], end[order]
    for chunk in chunked(group, spec):
        a, b = np.searchsorted(slot, [chunk.low, chunk.high])
        n = len(chunk.values)
        base = chunk.start[slot[a:b] - chunk.low]
        steps = np.bincount(base + begin[a:b], minlength=n + 1) - np.bincount(base + end[a:b], minlength=n + 1)
        yield chunk, np.cumsum(steps)[:n] > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def group_size(size: int) -> int:
    """Bytes of a group's text, given those of all."""
    return int(min(MOST_GROUP, max(LEAST_GROUP, GROUP_BYTES * (size / (1 << 30)) ** 0.5)))


def repeated_windows(docs: DataFrame, spec: Spec, decide: Callable[[pa.Table], pa.Table], finish: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str, group_bytes: int | None = None) -> DataFrame:
    """Run the five steps; `decide` is a bucket's work, `finish` makes a group's result rows.

    Each bucket is a partition of its own, so that no task gets several by chance.
    Rows without an id are dealt by a hash of their text.
    """
    size = total_bytes(docs)
    each = group_bytes or group_size(size)
    groups, buckets = parts_for(size, each), parts_for(size, min(each * GROUPS_A_BUCKET, MOST_BUCKET))
    dealt_by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    dealt = docs.select(F.pmod(dealt_by, F.lit(groups)).cast("int").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_group = dealt.groupBy("grp")
    anchors = by_group.applyInArrow(anchor_sender(spec, buckets), ANCHORS)
    shared = anchors.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(anchor_counter(spec), SHARED)
    segments = by_group.cogroup(shared.groupBy("grp")).applyInArrow(segment_sender(spec, buckets), SEGMENTS)
    covered = segments.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(decide, COVERED)
    return by_group.cogroup(covered.groupBy("grp")).applyInArrow(finish, schema)
