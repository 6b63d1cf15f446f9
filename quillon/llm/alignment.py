"""Operator 13: alignment of two tokenizers by interval coalescing.

Texts of a chunk lie end to end in one byte space that the tokens of both
tokenizers tile.  All tokens are sorted by start; ends are accumulated as a running
maximum, and a group breaks where a start reaches it.  Within a group every token
of A is linked with every one of B.

Each chunk (`CHUNK_BYTES` of text, or one longer text) keeps, packed, which of its
distinct id pairs each document holds and how often, and lists those pairs once.
Spark adds up in how many documents of the corpus each pair is held, finds every A
id's highest count, and gives each chunk the counts of its own pairs back.  So what
is exchanged follows the distinct pairs of the chunks, and a pair that all documents
hold is one row a chunk.

A's ids come from the ranks of the vocabulary file, which give the same tokens as
its merges where every merge makes the next id (checked when the file is read).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quillon.llm import textnp as tn
from quillon.llm.frames import cut, table

#: Where the vocabulary files of public tokenizers are, and which two are compared.
TOKENIZERS, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 1 << 20
#: Links of one group that are laid out one by one; larger groups are linked through their distinct ids.
PLAIN_LINKS = 4096

#: Fixed value: how a byte-level BPE cuts a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pair:
    """Two tokenizers and the bytes of their ids."""

    encode_a: object
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    @classmethod
    def of(cls, file_a: bytes, file_b: bytes) -> Pair:
        import sentencepiece
        import tiktoken

        model = json.loads(file_a)["model"]
        letter = byte_of_letter()
        ranks = {bytes(letter[c] for c in token): number for token, number in model["vocab"].items()}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        first = len(ranks) - len(merged)
        if any(model["vocab"][token] != first + i for i, token in enumerate(merged)):
            raise ValueError("the ids of the byte-level vocabulary do not follow its merges")
        a = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            bytes_a[number] = token
        b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        bytes_b = []
        for number in range(b.get_piece_size()):
            piece = b.id_to_piece(number)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(number) else piece.replace("▁", " ").encode())
        return cls(a, b, bytes_a, bytes_b)

    def tokens(self, texts: list[str]) -> tuple[list, list]:
        """Ids of both for every text; none where their bytes are not a space and the text."""
        out_a, out_b = [], []
        for text, b in zip(texts, self.encode_b.encode(texts, num_threads=1), strict=True):
            spaced = f" {text}"
            raw = spaced.encode()
            a = self.encode_a.encode_ordinary(spaced) if text else []
            same = bool(text) and b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            out_a.append(a if same else [])
            out_b.append(b if same else [])
        return out_a, out_b


_loaded: dict[str, Pair] = {}


def loaded(file_a: bytes, file_b: bytes) -> Pair:
    """The tokenizers of this worker, made once."""
    key = hashlib.sha256(file_a + file_b).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pair.of(file_a, file_b)
    return _loaded[key]


def coalesced(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of every interval: a group breaks where a start reaches the greatest end before it."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group


@dataclass
class Aligned:
    """The tokens of a chunk: ids, document and group of each, for A and B; groups are numbered over the chunk."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray
    doc_of_group: np.ndarray


def align(lists_a: list, lists_b: list, length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """Group the tokens of a chunk's documents."""
    sizes_a, sizes_b = (np.array([len(x) for x in lists], np.int64) for lists in (lists_a, lists_b))
    ids_a, ids_b = (np.fromiter((i for x in lists for i in x), np.int64, int(n.sum())) for lists, n in ((lists_a, sizes_a), (lists_b, sizes_b)))
    end_a, end_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    group = coalesced(np.concatenate([end_a - length_a[ids_a], end_b - length_b[ids_b]]), np.concatenate([end_a, end_b]))
    group_a, group_b = group[: len(ids_a)], group[len(ids_a) :]
    n = int(group.max()) + 1 if len(group) else 0
    doc_a, doc_b = (np.repeat(np.arange(len(s)), s) for s in (sizes_a, sizes_b))
    doc_of_group = np.zeros(n, np.int64)
    doc_of_group[group_a] = doc_a
    return Aligned(ids_a, ids_b, doc_a, doc_b, group_a, group_b, np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n), doc_of_group)


def links(x: Aligned, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which id pairs (``a * width + b``) every document holds linked, and how often: documents, pairs, times, in that order."""
    first_b = np.cumsum(x.size_b) - x.size_b
    plain = x.size_a * x.size_b <= PLAIN_LINKS
    at = np.flatnonzero(plain[x.group_a])
    each = x.size_b[x.group_a[at]]
    pair = np.repeat(x.ids_a[at] * width, each) + x.ids_b[tn.ranges(first_b[x.group_a[at]], each)]
    doc, times = np.repeat(x.doc_a[at], each), None
    if not plain.all():
        first_a = np.cumsum(x.size_a) - x.size_a
        docs, pairs, counts = [doc], [pair], [np.ones(len(doc), np.int64)]
        for g in np.flatnonzero(~plain).tolist():
            own_a, n_a = np.unique(x.ids_a[first_a[g] : first_a[g] + x.size_a[g]], return_counts=True)
            own_b, n_b = np.unique(x.ids_b[first_b[g] : first_b[g] + x.size_b[g]], return_counts=True)
            pairs.append((own_a[:, None] * width + own_b).ravel())
            counts.append((n_a[:, None] * n_b).ravel())
            docs.append(np.full(len(own_a) * len(own_b), x.doc_of_group[g]))
        doc, pair, times = (np.concatenate(z) for z in (docs, pairs, counts))
    names = np.unique(pair)
    # a document's pair in one number, so that one sort brings equal ones together
    key = doc * len(names) + np.searchsorted(names, pair)
    if times is None:
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.add.reduceat(times[order], first)
    key = key[first]
    if not len(names):
        return key, key, times
    return key // len(names), names[key % len(names)], times


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n, left-aligned, and how many each has."""
    text = [str(i).encode() for i in range(n)]
    wide = max(map(len, text))
    return np.frombuffer(b"".join(t.ljust(wide) for t in text), np.uint8).reshape(n, wide), np.array([len(t) for t in text], np.int64)


def rendered(x: Aligned, n_docs: int, digits_a: tuple, digits_b: tuple) -> tuple[bytes, np.ndarray]:
    """The groups of all documents as ``a1,a2|b1;a3|b2,b3`` laid end to end, and where each document's begin (n + 1)."""
    total = len(x.ids_a) + len(x.ids_b)
    before_a = np.cumsum(x.size_a)
    before_b = np.cumsum(x.size_b)
    place_a = np.arange(len(x.ids_a)) + (before_b - x.size_b)[x.group_a]
    place_b = np.arange(len(x.ids_b)) + before_a[x.group_b]
    size = np.empty(total, np.int64)
    size[place_a], size[place_b] = digits_a[1][x.ids_a], digits_b[1][x.ids_b]
    mark = np.full(total, ord(","), np.uint8)
    mark[place_a[before_a - 1]] = ord("|")
    last = place_b[before_b - 1]
    mark[last] = ord(";")
    final = np.flatnonzero(np.append(x.doc_of_group[1:] != x.doc_of_group[:-1], True)) if len(last) else np.zeros(0, np.int64)
    width = size + 1
    # a document's last group has no mark
    width[last[final]] -= 1
    end = np.cumsum(width)
    out = np.zeros(int(end[-1]) if total else 0, np.uint8)
    begin = end - width
    for place, ids, (letters, many) in ((place_a, x.ids_a, digits_a), (place_b, x.ids_b, digits_b)):
        for d in range(letters.shape[1]):
            has = np.flatnonzero(many[ids] > d)
            out[begin[place[has]] + d] = letters[ids[has], d]
    marked = np.ones(total, bool)
    marked[last[final]] = False
    out[(begin + size)[marked]] = mark[marked]
    per_doc = np.zeros(n_docs, np.int64)
    np.add.at(per_doc, x.doc_of_group[final], np.diff(np.append(0, end[last[final]])))
    return out.tobytes(), np.append(0, np.cumsum(per_doc))


_CHUNKS = "chunk long, ids array<long>, numbers binary, digests array<string>, groups array<string>, packed binary, pairs array<long>, docs array<int>"


def _chunker(files, with_groups: bool):
    """Tokenize, group and pack; batches have ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(*files.value)
        length_a, length_b = (np.array([len(t) for t in tokens], np.int64) for tokens in (pair.bytes_a, pair.bytes_b))
        digits_a, digits_b = _digits(len(length_a)), _digits(len(length_b))
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = tn.binary_buffers(batch.column(1))
            for low, high in tn.chunks(offsets, CHUNK_BYTES):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                x = align(*pair.tokens(texts), length_a, length_b)
                n = len(texts)
                doc, held, times = links(x, len(length_b))
                pairs, at = np.unique(held, return_inverse=True)
                n_links = np.zeros(n, np.int64)
                np.add.at(n_links, x.doc_of_group, x.size_a * x.size_b)
                numbers = np.stack([np.bincount(x.doc_a, minlength=n), np.bincount(x.doc_b, minlength=n), np.bincount(x.doc_of_group, minlength=n), n_links, np.bincount(doc, minlength=n)])
                said, where = rendered(x, n, digits_a, digits_b)
                spans = [said[a:z] for a, z in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                row = {
                    "chunk": chunk,
                    "ids": batch.column(0).slice(low, n).to_pylist(),
                    "numbers": numbers.astype(np.int64).tobytes(),
                    "digests": [hashlib.sha256(s).hexdigest() if s else "" for s in spans],
                    "groups": [s.decode() for s in spans] if with_groups else None,
                    "packed": tn.pack(at.astype(np.uint32), times.astype(np.int64)),
                    "pairs": pairs,
                    "docs": np.bincount(at, minlength=len(pairs)).astype(np.int32),
                }
                chunk += 1
                arrays = [pa.array([row[f.name]], f.type) for f in _ARROW]
                yield pa.RecordBatch.from_arrays(arrays, _ARROW.names)

    return run


_ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("numbers", pa.binary()), ("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), ("packed", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))])
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counter(with_groups: bool):
    """A row a document from chunks with the counts of their pairs: ``ids, numbers, digests, packed[, groups], answers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c, i=i, b=batch: b.column(c)[i]
                numbers = np.frombuffer(cell("numbers").as_py(), np.int64).reshape(5, -1)
                at, times = tn.unpack(cell("packed").as_py(), np.uint32, np.int64)
                doc = np.repeat(np.arange(numbers.shape[1]), numbers[4])
                counts, best = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64), np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
                if len(at):
                    answers = cell("answers").values
                    where = answers.field("at").to_numpy()
                    counts[where], best[where] = answers.field("n").to_numpy(), answers.field("best").to_numpy()
                n_best, count_sum = np.zeros(numbers.shape[1], np.int64), np.zeros(numbers.shape[1], np.int64)
                np.add.at(n_best, doc, times * best[at])
                np.add.at(count_sum, doc, times * counts[at])
                columns = [cell("ids").values, *(pa.array(numbers[j]) for j in range(4)), pa.array(n_best), pa.array(count_sum), cell("digests").values]
                names = [c.split()[0] for c in _RESULT.split(", ")]
                if with_groups:
                    columns, names = [*columns, cell("groups").values], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS, file_a: str = FILE_A, file_b: str = FILE_B, with_groups: bool = False) -> DataFrame:
    """Align the tokens of a byte-level BPE (A, of a space and the text) with those of a piece BPE (B, which adds the space).

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever
    their names.  Returns per row ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256`` and, with `with_groups`, ``groups``, which is
    ``a1,a2|b1;a3|b2,b3``: the decimal ids of the groups in order.  A pair's count is
    the number of rows that hold it linked; ``n_best`` are the links whose count is
    the highest of their A id (ties included), ``count_sum`` adds the counts of all
    links.

    Texts that are null or empty, or whose tokens do not spell a space and the text
    in both, have no tokens: zeros and ''.  Strings of special tokens are plain text.
    Rows that share an id are documents of their own; ids may be null.  An empty table
    gives an empty result.  The vocabulary files are read by the driver from `folder`
    and broadcast (a few MB, whatever the data).
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((Path(folder, file_a).read_bytes(), Path(folder, file_b).read_bytes()))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = cut(slim.mapInArrow(_chunker(files, with_groups), _CHUNKS))
    width = len(loaded(*files.value).bytes_b)
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "one")).select("chunk", "at", F.col("one.pairs").alias("pair"), F.col("one.docs").alias("docs"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n"))
    # an A id has at most as many partners as B has ids
    highest = F.max("n").over(Window.partitionBy(F.expr(f"pair div {width}")))
    known = counts.select("pair", "n", (F.col("n") == highest).cast("long").alias("best"))
    answers = held.join(known, "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("answers"))
    own = ["ids", "numbers", "digests", "packed", *(["groups"] if with_groups else [])]
    joined = chunks.select("chunk", *own).join(answers, "chunk", "left")
    return joined.select(*own, "answers").mapInArrow(_counter(with_groups), _RESULT + (", groups string" if with_groups else ""))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents``, byte_bpe_50k against piece_bpe_32k."""
    return align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
