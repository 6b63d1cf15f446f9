"""Operator 5: media columns as interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs; a
reference carries the digest of its payload, its position and its caption.
Payloads live in a media table (digest, stored form); a join by digest resolves
the references, so positions and captions stay aligned with the payload.

The stored form is a portable graymap: a header and 8-bit samples, `ROW` to a row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textnp as tn
from quillon.llm.frames import attached, cut, table

#: Samples of a row; payloads are padded with spaces to whole rows, one at least.
ROW = 192
_VOID_OF_TEXT = {"script", "style", "head", "noscript", "template"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "section", "article", "figure", "body", "blockquote", "pre", "header", "footer", "nav", "aside"}


class _Sequence(HTMLParser):
    """Collects (kind, text, reference, caption) in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def end_text(self) -> None:
        said = " ".join("".join(self.words).split())
        self.words = []
        if said:
            self.parts.append(["text", said, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID_OF_TEXT:
            self.silent += 1
        elif tag in ("img", "audio", "video", "source", "embed"):
            given = dict(attrs)
            if given.get("src"):
                self.end_text()
                self.parts.append(["media", None, given["src"], given.get("alt") or None])
                if self.figure is not None:
                    self.figure.append(len(self.parts) - 1)
        elif tag == "figcaption":
            self.end_text()
            self.caption = []
        elif tag in _BLOCKS:
            self.end_text()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID_OF_TEXT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figure:
                for i in self.figure:
                    self.parts[i][3] = said
            elif said:
                self.parts.append(["text", said, None, None])
        elif tag in _BLOCKS:
            self.end_text()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """The sequence of one page; null and empty pages have none."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end_text()
    return [{"position": i, "kind": k, "text": t, "reference": r, "caption": c} for i, (k, t, r, c) in enumerate(parser.parts)]


PART = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())])
SEQUENCE = "array<struct<position int, kind string, text string, reference string, caption string>>"


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key`` and ``sequence``: the ordered parts of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in tn.chunks(tn.binary_buffers(batch.column(1))[1]):
                part = batch.slice(low, high - low)
                parsed = [parse_html(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(parsed, pa.list_(PART))], [key, "sequence"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {kind}, sequence {SEQUENCE}")


def padded(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of `ROW`."""
    return payload.ljust(max(1, -(-len(payload) // ROW)) * ROW, b" ")


def encode(payload: bytes) -> bytes:
    """A padded payload as a graymap of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def decode(stored: bytes) -> np.ndarray:
    """The samples of a graymap, rows x columns."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    if magic != b"P5" or depth != b"255":
        raise ValueError("not an 8-bit graymap")
    width, height = map(int, size.split())
    return np.frombuffer(samples, np.uint8, width * height).reshape(height, width)


def difference_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of nine equal stripes in each of eight bands is darker than the next."""
    rows = np.arange(9) * samples.shape[0] // 8
    columns = np.arange(10) * samples.shape[1] // 9
    stripes = np.add.reduceat(samples.sum(axis=0, dtype=np.int64)[None, :], columns[:-1], axis=1) if samples.shape[0] < 8 else np.add.reduceat(np.add.reduceat(samples.astype(np.int64), rows[:-1], axis=0), columns[:-1], axis=1)
    bits = np.broadcast_to(stripes[:, :-1] < stripes[:, 1:], (8, 8))
    return np.packbits(bits).tobytes().hex()


def media_rows(docs: DataFrame) -> DataFrame:
    """The media table of texts: ``digest, n_bytes, media``; each digest once in a task's batch.

    ``docs`` has ``text``; ``digest`` is the SHA-256 of the text.  Texts are
    encoded in chunks of some bytes, and a longer text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            data, offsets = tn.binary_buffers(batch.column(0))
            for low, high in tn.chunks(offsets):
                digests, sizes, media = [], [], []
                for a, z in zip(offsets[low:high].tolist(), offsets[low + 1 : high + 1].tolist(), strict=True):
                    payload = data[a:z].tobytes()
                    digest = hashlib.sha256(payload).digest()
                    if digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        sizes.append(len(payload))
                        media.append(encode(padded(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["digest", "n_bytes", "media"])

    return docs.select("text").mapInArrow(run, "digest binary, n_bytes long, media binary")


FEATURES = "digest binary, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Features of stored media, computed from the bytes read back; digests are binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in FEATURES.split(", ")}
            for digest, n_bytes, stored in zip(batch.column("digest").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                raw = stored.as_py()
                samples = decode(raw)
                payload = samples.tobytes()
                feature = f"{samples.shape[1]}x{samples.shape[0]}:{difference_hash(samples)}"
                values = (digest, n_bytes, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).digest(), feature)
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(out)

    return media.select("digest", "n_bytes", "media").mapInArrow(run, FEATURES)


def references(parsed: DataFrame, key: str) -> DataFrame:
    """The media references of sequences: ``key, position, digest, reference, caption, text_before``.

    References of the form ``sha256:<digest>`` name a payload; others have an empty digest.
    """
    media = F.filter("sequence", lambda p: p["kind"] == "media")
    rows = parsed.select(key, "sequence", F.explode(media).alias("part"))
    before = F.filter("sequence", lambda p: (p["kind"] == "text") & (p["position"] < F.col("part.position")))
    digest = F.unhex(F.regexp_extract("part.reference", "^sha256:([0-9a-f]{64})$", 1))
    return rows.select(key, F.col("part.position").alias("position"), digest.alias("digest"), F.col("part.reference").alias("reference"), F.col("part.caption").alias("caption"), F.try_element_at(before, F.lit(-1))["text"].alias("text_before"))


def resolve(parsed: DataFrame, key: str, features: DataFrame) -> DataFrame:
    """Each media reference with what the media table knows of its payload (null if it isn't there).

    Payloads join by digest; a digest that very many references name is split over several tasks.
    """
    once = features.groupBy("digest").agg(*[F.first(c).alias(c) for c in features.columns if c != "digest"])
    found = attached(cut(references(parsed, key)), once, ["digest"], [key, "position"], how="left")
    shown = {c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")} | {"digest": F.when(F.length("digest") > 0, F.lower(F.hex("digest")))}
    return found.withColumns(shown)


def as_page(doc_id: Column, digest: Column) -> Column:
    """A document as a page: a heading, and a figure that refers to its payload."""
    name = F.concat(F.lit("document "), F.coalesce(doc_id.cast("string"), F.lit("without id")))
    return F.concat(F.lit("<article><h1>"), name, F.lit('</h1><figure><img src="sha256:'), digest, F.lit('"><figcaption>payload of '), name, F.lit("</figcaption></figure></article>"))


def document_media(docs: DataFrame) -> DataFrame:
    """Store every text as media, refer to it from a page, and resolve the page's reference.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  The media
    table is written to the shared folder and read back for the features.  Returns
    one row per input row: ``doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, position, caption``.

    Null texts count as empty; an empty payload is one row of spaces.  Equal texts
    share one digest and so have equal values.  Null ids stay null.  An empty table
    gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    features = media_features(cut(media_rows(slim)))
    pages = slim.select("doc_id", as_page(F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256)).alias("html"))
    found = resolve(sequences(pages, "doc_id"), "doc_id", features)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents as media, resolved through their pages."""
    return document_media(table(spark, sf_dir, "documents"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all ``pages`` in order, with the media they refer to: one row a page.

    Returns ``page_id, n_parts, n_media, captions, text_sha256`` (of the parts' texts,
    a line each).  Null and empty pages have no parts.
    """
    parsed = sequences(table(spark, sf_dir, "pages"), "page_id")
    kind = lambda k: F.filter("sequence", lambda p: p["kind"] == k)
    said = F.array_join(F.transform(kind("text"), lambda p: p["text"]), "\n")
    captions = F.array_compact(F.transform(kind("media"), lambda p: p["caption"]))
    return parsed.select("page_id", F.size("sequence").alias("n_parts"), F.size(kind("media")).alias("n_media"), F.array_join(captions, "\n").alias("captions"), F.sha2(said.cast("binary"), 256).alias("text_sha256"))
