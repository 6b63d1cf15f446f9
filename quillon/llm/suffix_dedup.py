"""Operator 9: suffix-array dedup by column-wise multi-string construction.

A bucket holds strings (runs of 50-byte windows around a shared anchor, see
`anchors`).  They are read column by column, from the last to the first: each
round prepends one symbol per string, updates the order of the suffixes of that
column by the Burrows-Wheeler step (stable sort by the new symbol, then by the
former order) and the common prefixes between neighbours (one more than the
least between their former places).  Windows whose suffixes share a prefix of
the window's length are equal; all but those of the least document are covered.

Strings are aligned at their anchor.  Two equal windows have their anchor at
the same place, so they are suffixes of the same column, and only the current
column's order has to be kept: it is the part of the collection's transform
that the round reads and replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import anchors as an
from quillon.llm import textnp as tn
from quillon.llm.frames import table

WINDOW = 50
GRAM = 24


def prefix_between(lcp: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of lcp[left+1 .. right] for each pair of places."""
    out = lcp[right]
    far = np.flatnonzero(right - left > 1)
    if len(far):
        bounds = np.empty(2 * len(far), np.int64)
        bounds[0::2], bounds[1::2] = left[far] + 1, right[far] + 1
        out[far] = np.minimum.reduceat(np.append(lcp, 0), bounds)[::2]
    return out


def equal_suffixes(data: np.ndarray, begin: np.ndarray, length: np.ndarray, offset: np.ndarray, group: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (string, column) that a string with a smaller owner has too.

    Strings of different groups are never compared.
    """
    low, high = -offset, length - offset
    entry = np.argsort(-high, kind="stable")
    ends = -high[entry]
    order = np.zeros(0, np.int64)
    lcp = np.zeros(0, np.int32)
    strings, columns = [], []
    for column in range(int(high.max()) - 1, int(low.min()) - 1, -1):
        if len(order):
            alive = low[order] <= column
            if not alive.all():
                kept = np.flatnonzero(alive)
                if len(kept):
                    lcp = np.minimum.reduceat(lcp[: kept[-1] + 1], np.append(0, kept[:-1] + 1))
                    order = order[kept]
                else:
                    order, lcp = order[:0], lcp[:0]
        a, b = np.searchsorted(ends, [-(column + 1), -column])
        fresh = entry[a:b]
        former = np.concatenate([fresh, order])
        before = np.concatenate([np.zeros(len(fresh), np.int32), lcp])
        if not len(former):
            continue
        bwt = data[begin[former] + offset[former] + column]
        key = (group[former] << 8) | bwt
        place = np.argsort((key << 32) | np.arange(len(former)))
        key = key[place]
        lcp = np.zeros(len(former), np.int32)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        left, right = place[same - 1], place[same]
        old = left >= len(fresh)
        lcp[same] = 1
        lcp[same[old]] += prefix_between(before, left[old], right[old])
        order = former[place]
        if (lcp >= window).any():
            start = np.flatnonzero(lcp < window)
            least = np.minimum.reduceat(owner[order], start)
            hit = order[owner[order] > np.repeat(least, np.diff(np.append(start, len(order))))]
            strings.append(hit)
            columns.append(np.full(len(hit), column))
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(strings), np.concatenate(columns)


def span_names(b: an.Bucket, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of `size` bytes from `offset` on of each string; some strings at a time, as hashing takes many bytes a byte."""
    names = np.empty(len(b.begin), np.uint64)
    ends = np.append(b.begin, len(b.data))
    for i, j in tn.chunks(ends):
        values = tn.byte_values(b.data[ends[i] : ends[j]])
        at = b.begin[i:j] - ends[i] + offset[i:j]
        names[i:j] = tn.value_span_hashes(values, at, at + size[i:j])
    return names


def decide(spec: an.Spec):
    """A bucket's strings, column by column; the covered windows of every occurrence."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("grp")
        b = an.unpacked(rows)
        owner = b.doc[b.first[:-1]]
        # single windows of hot anchors (offset -1) are aligned at their start
        alone = b.offset < 0
        offset = np.where(alone, 0, b.offset)
        size = np.where(alone, spec.window, spec.gram)
        anchor = span_names(b, offset, size)
        group = np.unique(anchor, return_inverse=True)[1].ravel()
        # a group of one string, or of one document, has nothing to compare
        least = np.full(int(group.max()) + 1 if len(group) else 0, an.NO_ID)
        np.minimum.at(least, group, owner)
        alive = np.zeros(len(least), bool)
        alive[group[owner > least[group]]] = True
        pick = np.flatnonzero(alive[group])
        if len(pick):
            s, column = equal_suffixes(b.data, b.begin[pick], b.length[pick], offset[pick], group[pick], owner[pick], spec.window)
            s, within = pick[s], column + offset[pick][s]
        else:
            s, within = pick, pick
        order = np.lexsort((within, s))
        s, within = s[order], within[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (within[1:] != within[:-1] + 1)
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(s)) - 1
        s, first, last = s[at], within[at] if len(at) else at, within[stop] if len(at) else at
        # to every occurrence of the string in its document
        times = np.diff(b.first)[s]
        spot = tn.ranges(b.first[:-1][s], times)
        base = b.place[spot]
        return an.covered_rows(rows, b, spot, base + np.repeat(first, times), base + np.repeat(last, times) + spec.window)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"


def finish(spec: an.Spec, with_bytes: bool):
    """Remove the covered bytes of each document."""

    def run(key: tuple, docs: pa.Table, covered: pa.Table) -> pa.Table:
        group = an.Group(docs)
        n_removed, n_spans, digests, rest = [], [], [], []
        for chunk, gone in an.masks(group, covered, spec):
            left = chunk.data[~gone].tobytes()
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            first = chunk.start[:-1][np.diff(chunk.start) > 0]
            rise[first] = gone[first]
            sums, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(rise))
            for a, z in zip(chunk.start[:-1].tolist(), chunk.start[1:].tolist(), strict=True):
                kept = left[a - int(sums[a]) : z - int(sums[z])]
                n_removed.append(int(sums[z] - sums[a]))
                n_spans.append(int(spans[z] - spans[a]))
                digests.append(an.sha256(kept))
                rest.append(kept if with_bytes else None)
        return pa.table(
            {
                "doc_id": pa.array(group.ids, pa.int64(), mask=group.null),
                "n_bytes": pa.array(np.diff(group.offsets), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "kept_bytes": pa.array(rest, pa.binary()),
            }
        )

    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = 2048, with_bytes: bool = True, group_bytes: int | None = None) -> DataFrame:
    """Remove each byte covered by a `window`-byte string that also starts in a document with a smaller ``doc_id``.

    Matches never cross documents and are judged on the input.  ``docs`` needs
    ``doc_id`` and ``text``; other columns are ignored, whatever their names.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept_bytes`` (null unless `with_bytes`).

    Null text: no bytes.  Texts shorter than a window: nothing is removed.  Rows
    with a null ``doc_id`` count as after all others; rows that share a
    ``doc_id`` never cover each other.  An empty table gives an empty result.
    """
    spec = an.Spec(window=window, gram=min(gram, window), by_word=False, within_document=False, hot=hot)
    return an.repeated_windows(docs, spec, decide(spec), finish(spec, with_bytes), RESULT, group_bytes)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 50-byte strings over all of ``documents``."""
    return suffix_dedup(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept_bytes")
