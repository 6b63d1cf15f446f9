"""Operator 10: near-duplicate groups by min-max hashing.

Each permutation of a document's shingles gives two values, its least and its
greatest, so a signature of 2P values costs P hash evaluations.  Four values
(two permutations) make a band.  Documents with the same set are one class;
classes that share a band are candidates, and every link is confirmed on the
full sets.

Within a band's bucket no list of all pairs is made.  Each class is compared with
the bucket's least class, and linked classes become components.  Pairs inside a
component need no further comparison; what is left is links between components
that share a bucket.  In buckets of at most `SMALL` classes the classes outside
the main component are compared with the others.  For larger buckets an exact
bound takes the place of pairs: sets as similar as asked share one of their
rarest few shingles, so only classes that do are compared, again across
components.  No component is lost against comparing all candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textnp as tn
from quillon.llm.components import components
from quillon.llm.frames import attached, cut, discard, parts_for, table, with_totals

#: At similarity 0.8 a band of two permutations agrees with probability 0.8**4; 32 bands all differ once in 2 * 10**7 pairs.
BANDS = 32
PERCENT = 80
SMALL = 32


def document_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document of a chunk, sorted, laid end to end, and how many each has."""
    lower = tn.LOWER[data]
    begin, end, start = tn.words(lower, offsets)
    values = tn.span_hashes(lower, begin, end)
    grams = tn.gram_hashes(values, shingle)
    sets = []
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if b - a >= shingle:
            sets.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            sets.append(tn.gram_hashes(values[a:b], b - a))
        else:
            sets.append(grams[:0])
    return np.concatenate(sets) if sets else grams[:0], np.array([len(s) for s in sets], np.int64)


def min_max_bands(values: np.ndarray, sizes: np.ndarray, bands: int) -> np.ndarray:
    """Band keys (documents x bands) of non-empty sets laid end to end."""
    start = np.cumsum(sizes) - sizes
    rng = np.random.Generator(np.random.PCG64(7))
    factors = rng.integers(0, 1 << 63, 2 * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, 2 * bands, dtype=np.uint64)
    keys = np.empty((len(sizes), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sizes), band + 1, np.uint64)
        for p in (2 * band, 2 * band + 1):
            hashed = values * factors[p] + shifts[p]
            key = tn.mix(key + np.minimum.reduceat(hashed, start))
            key = tn.mix(key + np.maximum.reduceat(hashed, start))
        keys[:, band] = key
    return keys


FEATURES = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>"


def _features(shingle: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tn.binary_buffers(batch.column("text"))
            for low, high in tn.chunks(offsets):
                values, sizes = document_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shingle)
                full = sizes > 0
                start = (np.cumsum(sizes) - sizes)[full]
                digests = np.zeros((2, len(sizes)), np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if len(start):
                    for i in range(2):
                        digests[i, full] = np.add.reduceat(tn.mix(values ^ np.uint64(0x1B873593 + i)), start)
                    keys = min_max_bands(values, sizes[full], bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low).cast(pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests[0].view(np.int64)),
                        pa.array(digests[1].view(np.int64)),
                        tn.list_column(keys.ravel().view(np.int64), full * bands, pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "digest_a", "digest_b", "bands"],
                )

    return run


def _sets(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tn.binary_buffers(batch.column("text"))
            for low, high in tn.chunks(offsets):
                values, sizes = document_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shingle)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low).cast(pa.int64()), tn.list_column(values.view(np.int64), sizes, pa.int64())], ["doc_id", "shingles"])

    return run


def _near(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least the similarity; a class with very many pairs is split."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = attached(attached(pairs, left, ["a"], ["b"]), right, ["b"], ["a"], base=pairs).select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return joined.filter(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b").distinct()


def _open(entries: DataFrame, base: DataFrame) -> DataFrame:
    """Entries (``key, node, n_shingles, root, nth``) of keys with several components, with the key's main one and its size; `base` has their keys and nodes."""
    counts = entries.groupBy("key", "root").agg(F.count("*").alias("n"))
    mains = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("members"))
    return attached(entries, mains.filter("roots > 1").drop("roots"), ["key"], ["node"], base=base)


def _crossing(opened: DataFrame, percent: int, base: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of a key: a class outside the main component with one of another component.

    Where a key may have any number of classes, `base` is a written table with the
    keys: the classes outside the main component of a hot key are dealt over tasks,
    each with all classes of the key.
    """
    side = lambda rows, name: rows.select("key", F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n_shingles", "root", "nth")])
    rest = lambda name: F.col(f"n_shingles_{name}") - F.col(f"nth_{name}")
    # what the sets can share at most if the key is the first of their shingles that they share
    reach = (F.least(rest("x"), rest("y")) + 1) * (100 + percent) >= (F.col("n_shingles_x") + F.col("n_shingles_y")) * percent
    outside, every = side(opened.filter("root <> main"), "x"), side(opened, "y")
    met = outside.join(every, "key") if base is None else attached(outside, every, ["key"], ["x"], base=base)
    met = met.filter("root_x <> root_y").filter(reach)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


#: Shingles of the classes of one group.
GROUP_TOKENS = 1 << 20
_COUNTS = "bucket int, grp int, tokens array<long>, counts array<long>"
_OFTEN = "grp int, tokens array<long>, often array<long>"
_ENTRIES = "key long, node long, n_shingles long, root long, nth int"


def _token_sender(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A group's distinct shingles and how many of its classes have each, by bucket."""

    def send(key: tuple, classes: pa.Table) -> pa.Table:
        tokens, counts = np.unique(tn.flat(classes["shingles"])[0], return_counts=True)
        bucket = (tn.mix(tokens.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        kinds, sizes = np.unique(bucket, return_counts=True)
        return pa.table({"bucket": pa.array(kinds, pa.int32()), "grp": pa.array(np.full(len(kinds), key[0].as_py()), pa.int32()), "tokens": tn.list_column(tokens[order], sizes, pa.int64()), "counts": tn.list_column(counts[order], sizes, pa.int64())})

    return send


def _token_counter(rows: pa.Table) -> pa.Table:
    """A bucket's shingles that several classes have, with how many do, for each group that has them."""
    tokens, sizes = tn.flat(rows["tokens"])
    counts, _ = tn.flat(rows["counts"])
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
    total = np.empty(len(order), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(order)))) if len(at) else at
    keep = total > 1
    kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
    return pa.table({"grp": rows["grp"].cast(pa.int32()), "tokens": tn.list_column(tokens[keep], kept, pa.int64()), "often": tn.list_column(total[keep], kept, pa.int64())})


def _rarest_of(percent: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The entries of a group's classes, given the shingles that are not theirs alone."""

    def pick(key: tuple, classes: pa.Table, shared: pa.Table) -> pa.Table:
        tokens, sizes = tn.flat(classes["shingles"])
        known, often = tn.flat(shared["tokens"])[0], tn.flat(shared["often"])[0]
        by = np.argsort(known, kind="stable")
        known, often = known[by], often[by]
        times = np.ones(len(tokens), np.int64)
        if len(known):
            spot = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            times = np.where(known[spot] == tokens, often[spot], 1)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((tokens, times, row))
        nth = np.arange(len(tokens)) - (np.cumsum(sizes) - sizes)[row] + 1
        n = classes["n_shingles"].to_numpy()
        few = n + (-n * percent) // 100 + 1
        take = (nth <= few[row]) & (times[order] > 1)
        whose = pa.array(row[take])
        return pa.table({"key": pa.array(tokens[order[take]], pa.int64()), **{c: classes[c].take(whose).cast(pa.int64()) for c in ("node", "n_shingles", "root")}, "nth": pa.array(nth[take], pa.int32())})

    return pick


def _rarest(nodes: DataFrame, sets: DataFrame, percent: int, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Entries of classes under their rarest shingles, as many as similar sets cannot all lack; ``nth`` is the rank.

    Classes are dealt into groups, as many as their shingles ask for.  A group
    sends its distinct shingles with counts to buckets, which add them up and send
    back those of several classes; only the rarest few of a class become rows.
    """
    groups = parts_for(nodes.agg(F.sum("n_shingles").alias("n")).first().n or 0, group_tokens, least=32)
    held = nodes.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    dealt = held.select(F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int").alias("grp"), "node", "n_shingles", "root", "shingles").groupBy("grp")
    sent = dealt.applyInArrow(_token_sender(groups), _COUNTS)
    counted = sent.groupBy("bucket").applyInArrow(_token_counter, _OFTEN)
    return dealt.cogroup(counted.groupBy("grp")).applyInArrow(_rarest_of(percent), _ENTRIES)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of `percent` / 100 or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text with fewer words than
    `shingle` has its whole sequence as one shingle.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.
    Texts without words (null too) are linked with nothing.  Rows with a null
    ``doc_id`` are linked with nothing and kept, with a null component.  Rows that
    share a ``doc_id`` are one document: it has the links of all of them.
    An empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = cut(slim.mapInArrow(_features(shingle, bands), FEATURES))
    digest = ["digest_a", "digest_b", "n_shingles"]
    real = features.filter("doc_id is not null and n_shingles > 0")
    classes = cut(real.groupBy(*digest).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    entries = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    centred = with_totals(entries, ["key"], ["node"], F.min(F.struct("node", "n_shingles")).alias("centre"), F.count("*").alias("n"), having="n > 1")
    members = cut(centred.select("key", "node", "n_shingles", F.col("centre.node").alias("centre"), F.col("centre.n_shingles").alias("n_centre")))
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = cut(slim.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, shingles array<long>"))
    tried = cut(members.filter(F.col("node") != F.col("centre")).filter(_near("n_shingles", "n_centre", percent)).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    links = cut(_linked(tried, sets, percent))
    roots = components(links)

    # links between components that share a bucket
    placed = members.join(roots, "node", "left").select("key", "node", "n_shingles", F.coalesce("root", "node").alias("root"), F.lit(1).alias("nth"))
    opened = cut(_open(placed, members))
    crowded = opened.filter(F.col("members") > SMALL).select("node", "n_shingles", "root").distinct()
    rarest = cut(_rarest(crowded, sets, percent))
    rare = cut(_open(rarest, rarest))
    crossing = _crossing(opened.filter(F.col("members") <= SMALL), percent).union(_crossing(rare, percent, rare)).distinct()
    fresh = cut(crossing.join(tried, ["a", "b"], "left_anti"))
    more = cut(_linked(fresh, sets, percent))
    if not more.isEmpty():
        roots = components(links.union(more))
    for done in (members, sets, tried, links, opened, rarest, rare, fresh, more):
        discard(done)

    named = classes.join(roots, "node", "left").select(*digest, F.coalesce("root", "node").alias("root"))
    # exact copies share a digest: a large group is split
    found = attached(features.filter("n_shingles > 0").select("doc_id", *digest), named, digest, ["doc_id"], how="left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))
    empty = features.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 2-word shingles over all of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
