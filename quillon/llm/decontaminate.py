"""Operator 7: benchmark decontamination with SimHash over item-sized windows.

Every benchmark item has a 64-bit SimHash of its five-word shingles, weighted by
their counts.  A document is read in windows as long as each item.  Fingerprints
are cut into four blocks of 16 bits.  Two fingerprints within `RADIUS` bits are,
in some block, within the bits that `REACH` says (one more in every block would
make `RADIUS` + 1), so the index lists each item under the block values within
one bit of its own and its length, windows look up those within the rest of the
reach, many windows at a time, and every item within the radius is met.  A random item is met by about a tenth of
the windows; candidates within the radius are verified by their exact weighted
Jaccard similarity.

The radius is a bound on recall: at a similarity of exactly 0.8 a bit differs
with a probability of about 0.15, so 18 of 64 or more do in less than one pair in
a hundred; at 0.9 in none of a million.

A window's similarity cannot reach the bound unless that share of its shingles
occurs in the benchmark at all; other windows are not fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textnp as tn
from quillon.llm.frames import cut, discard, hidden, parts_for, table, text_bytes

SHINGLE = 5
PERCENT = 80
#: Bits by which two fingerprints in one block may differ and still meet there.
REACH = (4, 4, 3, 3)
RADIUS = sum(REACH) + len(REACH) - 1
#: 16-bit values by how many bits they have, few first.
_BY_BITS = np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint32)), kind="stable").astype(np.uint32)
#: How many values have at most 0, 1, 2, 3 bits.
_WITHIN = np.cumsum([1, 16, 120, 560])
#: Keys of one look-up, in all blocks.
LOOKUP_KEYS = int(sum(_WITHIN[reach - 1] for reach in REACH))
#: Windows that are looked up at a time.
LOOKUP_ROWS = 128
#: Bytes of the index that is broadcast at once; the benchmark is read in blocks of so much.
BLOCK_BYTES = 32 << 20
#: Bytes of the index for an item, and for a byte of its text, at most.
ITEM_BYTES, TEXT_BYTES = 6500, 12
_FILTER_BITS = 22


def simhash(grams: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of shingle hashes (windows x shingles); a repeated shingle weighs more."""
    bits = np.unpackbits(np.ascontiguousarray(grams).view(np.uint8).reshape(*grams.shape, 8), axis=-1).reshape(len(grams), -1, 64)
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > grams.shape[1], axis=-1).view(np.uint64).ravel()


def _keys(fingerprints: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Look-up keys (fingerprints x values) of a block's values within so many bits."""
    value = (fingerprints >> np.uint64(16 * block)).astype(np.uint32) & np.uint32(0xFFFF)
    return (np.uint32(block) << np.uint32(16)) | (value[:, None] ^ _BY_BITS[: _WITHIN[bits]])


def _place(keys: np.ndarray, lengths: np.ndarray | int, bits: int) -> np.ndarray:
    """Where a block value is listed for items of a length."""
    salt = (np.asarray(lengths, np.uint64) * np.uint64(0x85EBCA77)).astype(np.uint32)
    return (keys * np.uint32(0x9E3779B1) ^ salt) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - bits)


@dataclass
class Lookup:
    """Multi-index of all items: fingerprints and lengths, and item numbers by a hash of block value and length.

    ``first`` says where the items of each of ``2 ** bits`` hash values begin in
    ``listed``, ``taken`` whether there are any; ``keys`` are the block values they are listed under, by which those
    that meet by chance only are told apart.
    """

    fingerprints: np.ndarray
    lengths: np.ndarray
    taken: np.ndarray
    first: np.ndarray
    listed: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, lengths: np.ndarray) -> Lookup:
        keys = np.concatenate([_keys(fingerprints, b, 1) for b in range(len(REACH))], axis=1)
        bits = max(8, int(keys.size).bit_length() + 3)
        places = _place(keys, lengths[:, None], bits).ravel()
        order = np.argsort(places, kind="stable")
        many = np.bincount(places, minlength=1 << bits)
        return cls(fingerprints, lengths, many > 0, np.append(0, np.cumsum(many)).astype(np.int32), np.repeat(np.arange(len(fingerprints), dtype=np.int32), keys.shape[1])[order], keys.ravel()[order])

    def candidates(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Items of the length that share a block value nearly enough with a fingerprint: fingerprint numbers and item numbers, each pair once."""
        asked = np.concatenate([_keys(prints, b, reach - 1) for b, reach in enumerate(REACH)], axis=1)
        places = _place(asked, length, (len(self.first) - 1).bit_length() - 1)
        hit = np.flatnonzero(self.taken[places])
        places = places.ravel()[hit].astype(np.int64)
        begin = self.first[places].astype(np.int64)
        many = self.first[places + 1] - begin
        where = tn.ranges(begin, many)
        item = self.listed[where].astype(np.int64)
        fits = np.flatnonzero((self.keys[where] == np.repeat(asked.ravel()[hit], many)) & (self.lengths[item] == length))
        pair = np.unique(np.repeat(hit // asked.shape[1], many)[fits] * len(self.fingerprints) + item[fits])
        return pair // max(len(self.fingerprints), 1), pair % max(len(self.fingerprints), 1)

    def within(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates within the radius."""
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(prints), LOOKUP_ROWS):
            some = prints[low : low + LOOKUP_ROWS]
            row, item = self.candidates(some, length)
            near = np.bitwise_count(self.fingerprints[item] ^ some[row]) <= RADIUS
            found[0].append(row[near] + low)
            found[1].append(item[near])
        return np.concatenate(found[0]), np.concatenate(found[1])


@dataclass
class Index:
    """Items: ids, distinct shingles with counts (laid end to end), the multi-index, lengths that occur; and which shingles occur at all."""

    item_ids: np.ndarray
    start: np.ndarray
    shingles: np.ndarray
    times: np.ndarray
    lookup: Lookup
    lengths: list[int]
    known: dict[int, np.ndarray]
    sieve: dict[int, np.ndarray]


def build_index(rows: list[tuple[int, str]], shingle: int) -> Index:
    """Index some items; items without words are left out."""
    ids, sizes, prints, shingles, times = [], [], [], [], []
    grams_by_k: dict[int, list] = {}
    for item_id, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        lower = tn.LOWER[raw]
        begin, end, _ = tn.words(lower, np.array([0, len(raw)]), tn.NOT_ALNUM)
        if not len(begin):
            continue
        k = min(shingle, len(begin))
        grams = tn.gram_hashes(tn.span_hashes(lower, begin, end), k)
        own, counts = np.unique(grams, return_counts=True)
        grams_by_k.setdefault(k, []).append(own)
        ids.append(item_id)
        sizes.append(len(begin))
        prints.append(simhash(grams[None, :])[0])
        shingles.append(own)
        times.append(counts.astype(np.int32))
    length, prints = np.array(sizes, np.int64), np.array(prints, np.uint64)
    known = {k: np.unique(np.concatenate(parts)) for k, parts in grams_by_k.items()}
    sieve = {k: np.zeros(1 << _FILTER_BITS, bool) for k in known}
    for k, values in known.items():
        sieve[k][(values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    start = np.append(0, np.cumsum([len(x) for x in shingles])).astype(np.int64)
    return Index(np.array(ids, np.int64), start, np.concatenate(shingles or [np.zeros(0, np.uint64)]), np.concatenate(times or [np.zeros(0, np.int32)]), Lookup.of(prints, length), sorted(set(sizes)), known, sieve)


def similar(index: Index, item: int, own: np.ndarray, counts: np.ndarray, percent: int) -> float | None:
    """The weighted Jaccard similarity of a window's shingles and an item's, or None below the bound.

    Summed least counts over summed greatest counts.
    """
    a, z = index.start[item], index.start[item + 1]
    _, mine, theirs = np.intersect1d(own, index.shingles[a:z], assume_unique=True, return_indices=True)
    both = int(np.minimum(counts[mine], index.times[a:z][theirs]).sum())
    every = int(counts.sum()) + int(index.times[a:z].sum()) - both
    return both / every if both * 100 >= percent * every else None


def matches(index: Index, windows: np.ndarray, length: int, percent: int) -> list[list[tuple[int, float]]]:
    """For each window (a row of shingle hashes): items of the length within the radius that it resembles, and how much."""
    out: list[list[tuple[int, float]]] = [[] for _ in windows]
    rows, items = index.lookup.within(simhash(windows), length)
    grams: dict[int, tuple] = {}
    for row, item in zip(rows.tolist(), items.tolist(), strict=True):
        if row not in grams:
            grams[row] = np.unique(windows[row], return_counts=True)
        s = similar(index, item, *grams[row], percent)
        if s is not None:
            out[row].append((item, s))
    return out


def _known(index: Index, k: int, grams: np.ndarray) -> np.ndarray:
    """Which shingles occur in the benchmark."""
    hit = index.sieve[k][(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
    at = np.flatnonzero(hit)
    known = index.known[k]
    hit[at] = known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]
    return hit


def scan(index: Index, data: np.ndarray, offsets: np.ndarray, shingle: int, percent: int, memo: dict) -> list[dict[int, float]]:
    """For each document of a chunk: items it resembles, and how much at best."""
    lower = tn.LOWER[data]
    begin, end, start = tn.words(lower, offsets, tn.NOT_ALNUM)
    values = tn.span_hashes(lower, begin, end)
    found: list[dict[int, float]] = [{} for _ in range(len(offsets) - 1)]
    for k in index.known:
        grams = tn.gram_hashes(values, k)
        hit = _known(index, k, grams)
        # a shingle that reaches into the next document is none
        where = np.flatnonzero(hit)
        doc = np.searchsorted(start, where, side="right") - 1
        inside = where + k <= start[doc + 1] if len(where) else np.zeros(0, bool)
        for d in np.unique(doc[inside]).tolist():
            a, z = int(start[d]), int(start[d + 1])
            own, sums = grams[a : z - k + 1], np.append(0, np.cumsum(hit[a : z - k + 1]))
            for length in index.lengths:
                if min(shingle, length) != k:
                    continue
                size = min(length, z - a) - k + 1
                if size <= 0:
                    continue
                covered = sums[size:] - sums[:-size]
                at = np.flatnonzero(covered * 100 >= size * percent)
                if not len(at):
                    continue
                windows = own[at[:, None] + np.arange(size)]
                names = tn.mix(windows + np.arange(size, dtype=np.uint64)).sum(axis=1).tolist()
                fresh = [i for i, name in enumerate(names) if (length, size, name) not in memo]
                if fresh:
                    for i, found_here in zip(fresh, matches(index, windows[fresh], length, percent), strict=True):
                        memo[length, size, names[i]] = found_here
                for name in names:
                    for i, s in memo[length, size, name]:
                        found[d][i] = max(s, found[d].get(i, 0.0))
    return found


NEW = ["contaminated", "n_items", "item_ids", "similarity"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds the benchmark items that each document holds, wholly or nearly.

    Words are runs of letters and digits, A-Z lowered.  A document holds an item
    if some window of the item's length in words (the whole document if it is
    shorter) has a weighted Jaccard similarity of `percent` / 100 with the item,
    on shingles of `shingle` words (shorter items: the whole item), and their
    fingerprints differ in at most `RADIUS` bits.

    ``docs`` needs ``text``; all its columns stay, whatever their names, but for
    those named like the new ones, which are replaced: ``contaminated``,
    ``n_items``, ``item_ids`` (sorted), ``similarity`` (the highest; null if
    none).  ``benchmark`` needs ``item_id`` and ``text``.  A benchmark whose index
    exceeds `block_bytes` is broadcast in blocks, which pass over the documents
    one after another; each pass is written to the shared folder and its block
    freed, so no more than one block is held at a time.

    Null or empty texts are clean; items without words or without an id are
    ignored; several items of one id count as one; a benchmark without rows
    leaves all documents clean.
    """
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    weight = items.agg(F.sum(text_bytes() * TEXT_BYTES + ITEM_BYTES).alias("n")).first().n or 0
    blocks = parts_for(weight, block_bytes, least=1)
    plain, back = hidden(docs.drop(*NEW), ["text"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    text_at = plain.columns.index("text")
    out = plain.withColumn("found", F.create_map().cast("map<bigint,double>"))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        index = build_index([tuple(r) for r in part.orderBy("item_id", "text").collect()], shingle)
        shared = spark.sparkContext.broadcast(index)
        out = out.mapInArrow(_scanner(shared, text_at, shingle, percent), f"{kinds}, found map<bigint,double>")
        if blocks > 1:
            written = cut(out)
            shared.unpersist()
            if block:
                discard(out_before)
            out = out_before = written
    ids = F.array_sort(F.map_keys("found"))
    return out.select(*back, (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), ids.alias("item_ids"), F.array_max(F.map_values("found")).alias("similarity"))


def _scanner(shared, text_at: int, shingle: int, percent: int):
    """Adds one block's items to the last column of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = shared.value, {}
        for batch in batches:
            data, offsets = tn.binary_buffers(batch.column(text_at))
            best: list[dict[int, float]] = []
            for low, high in tn.chunks(offsets):
                if len(memo) > 200_000:
                    memo.clear()
                best += [_best(index, f) for f in scan(index, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shingle, percent, memo)]
            before = batch.column(batch.num_columns - 1).to_pylist()
            merged = [list({k: max(f.get(k, 0.0), dict(b).get(k, 0.0)) for k in dict(b) | f}.items()) for b, f in zip(before, best, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(merged, pa.map_(pa.int64(), pa.float64()))], batch.schema.names)

    return run


def _best(index: Index, found: dict[int, float]) -> dict[int, float]:
    """By item id; several items of one id count as one."""
    out: dict[int, float] = {}
    for i, s in found.items():
        item = int(index.item_ids[i])
        out[item] = max(s, out.get(item, 0.0))
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, five-word shingles, similarity 0.8."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *NEW)
