"""Operator 1: substring dedup by super-k-mer partitioning.

Windows of ``window`` consecutive words.  Consecutive windows that share a
minimiser travel as one packed string to the minimiser's bucket, where sorting
the windows counts them exactly (see `anchors` for the plan).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import anchors as an
from quillon.llm import textnp as tn
from quillon.llm.frames import table

WINDOW = 20
GRAM = 7


def word_ids(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An integer for each word of the packed strings (equal words, equal integer), and each string's first word."""
    bounds = np.append(begin, begin[-1] + length[-1]) if len(begin) else np.zeros(1, np.int64)
    first, last, start = tn.words(data, bounds)
    size = last - first
    where = np.append(0, np.cumsum(size)).astype(np.int64)
    raw = data[tn.ranges(first, size)]
    column = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(raw))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), start


def equal_windows(ids: np.ndarray, at: np.ndarray, window: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the windows that start at `at`; the order (ties by `tie`), and which of it differ from the one before.

    Windows are sorted by a 64-bit hash of their ids and neighbours are then
    compared id by id; should two contents share a hash, the windows are sorted
    by the ids themselves.
    """
    if not len(at):
        return at, np.zeros(0, bool)
    hashes = tn.gram_hashes(tn.mix(ids.astype(np.uint64) + np.uint64(1)), window)[at]
    order = np.lexsort((tie, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    same = np.flatnonzero(~new)
    step = np.arange(window)
    for a in range(0, len(same), 1 << 16):
        part = same[a : a + (1 << 16)]
        if (ids[at[order[part]][:, None] + step] != ids[at[order[part - 1]][:, None] + step]).any():
            _, name = np.unique(ids[at[:, None] + step], axis=0, return_inverse=True)
            order = np.lexsort((tie, name.ravel()))
            new[1:] = name.ravel()[order][1:] != name.ravel()[order][:-1]
            break
    return order, new


def decide(spec: an.Spec):
    """A bucket's windows, sorted: each but the first of equal ones starts earlier elsewhere."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("grp")
        b = an.unpacked(rows)
        ids, start = word_ids(b.data, b.begin, b.length)
        count = np.diff(start) - spec.window + 1
        at = tn.ranges(start[:-1], count)
        spot = np.repeat(b.first[:-1], count)
        begin = b.place[spot] + at - np.repeat(start[:-1], count)
        near = np.lexsort((begin, b.slot[spot], b.row[spot], b.doc[spot]))
        tie = np.empty(len(near), np.int64)
        tie[near] = np.arange(len(near))
        order, new = equal_windows(ids, at, spec.window, tie)
        hit = np.sort(order[~new])
        return an.covered_rows(rows, b, spot[hit], begin[hit], begin[hit] + spec.window)

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def finish(spec: an.Spec, with_text: bool):
    """Remove the covered words of each document and join what is left."""

    def run(key: tuple, docs: pa.Table, covered: pa.Table) -> pa.Table:
        group = an.Group(docs)
        n_words, n_removed, digests, texts = [], [], [], []
        for chunk, gone in an.masks(group, covered, spec):
            raw = chunk.data.tobytes()
            sums = np.append(0, np.cumsum(gone))
            for d in range(chunk.high - chunk.low):
                a, z = int(chunk.start[d]), int(chunk.start[d + 1])
                removed = int(sums[z] - sums[a])
                if z == a:
                    kept = b""
                elif removed == z - a:
                    kept = b""
                else:
                    pick = raw[chunk.begin[a] : chunk.end[z - 1]].split()
                    kept = b" ".join(pick if not removed else [w for w, out in zip(pick, gone[a:z].tolist(), strict=True) if not out])
                n_words.append(z - a)
                n_removed.append(removed)
                digests.append(an.sha256(kept))
                texts.append(kept if with_text else None)
        return pa.table(
            {
                "doc_id": pa.array(group.ids, pa.int64(), mask=group.null),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = 2048, with_text: bool = True, group_bytes: int | None = None) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier.

    Earlier: in a document with a smaller ``doc_id``, or before it in the same
    document.  Windows are judged on the input.  ``docs`` needs ``doc_id`` and
    ``text``; other columns are ignored, whatever their names.

    Returns one row per input row: ``doc_id, n_words, n_removed, kept_sha256,
    kept_text`` (kept words joined by one space; null unless `with_text`).

    Null text: no words.  Texts shorter than a window: nothing is removed.  Rows
    with a null ``doc_id`` come after all others, in the order of a hash of their
    text; rows that share a ``doc_id`` count as one after another, ordered by text,
    so the second of two equal rows loses its windows.  An empty table gives an empty result.
    """
    spec = an.Spec(window=window, gram=min(gram, window), by_word=True, within_document=True, hot=hot)
    return an.repeated_windows(docs, spec, decide(spec), finish(spec, with_text), RESULT, group_bytes)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 20-word windows over all of ``documents``."""
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
