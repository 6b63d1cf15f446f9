"""Sound files as a Spark data source: read in parts, written all or nothing.

* ``spark.read.format("quillon_sound").load(path)`` gives blocks of samples; a long
  file is several partitions, each of which reads the header and its own bytes, and
  short files share one.
* ``.option("read", "headers")`` gives lengths from the headers alone.
* ``df.write.format("quillon_sound").mode("append").save(path)`` writes a file for each
  row (``name, rate, samples``) and a manifest.  Tasks write into folders of their own
  below the job's, of at most a thousand files each; only when all have ended does
  the manifest name them, by one atomic move.  A job that fails takes its folder with
  it, and readers keep the old files.  The driver knows folders, and tasks list them.

Paths are those of pyarrow's file systems (local, HDFS, S3, GCS), so any executor can
read them.
"""

from __future__ import annotations

import io
import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillon.sources.sinks import wav_bytes

BLOCKS = "path string, rate int, channels int, block long, begin long, samples array<float>"
HEADERS = "path string, rate int, channels int, bits int, frames long, dur_us long, bytes_read long"
WRITTEN = "name string, rate int, samples array<double>"
#: Bytes of sound in a partition, and samples in a block, unless given.
PART_BYTES, BLOCK = 16 << 20, 1 << 16
MANIFEST = "_current.json"
#: Files and bytes of sound in a folder that a task writes; a longer file has one of its own.
FOLDER_FILES, FOLDER_BYTES = 1000, 64 << 20
#: Parts below `PART_BYTES` share partitions where there would be more of those than this.
SMALL_PARTS = 256


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Header:
    """What the header says; sound is in bytes ``at`` to ``at + size``.  ``bytes_read`` is what it took to know."""

    rate: int
    channels: int
    bits: int
    at: int
    size: int
    bytes_read: int

    @property
    def width(self) -> int:
        """Bytes of a frame."""
        return self.bits // 8 * self.channels

    @property
    def frames(self) -> int:
        return self.size // self.width


def header(file, length: int) -> Header | None:
    """Read chunk by chunk up to the sound; None if it is no 8- or 16-bit PCM file.

    Only chunk heads and the format are read, so a long chunk before the sound costs nothing.
    """
    read = 12
    start = file.read(12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= length:
        file.seek(at)
        head = file.read(8)
        read += len(head)
        if len(head) < 8:
            return None
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"data":
            return Header(form[1], form[0], form[2], at + 8, min(size, length - at - 8), read) if form else None
        if name == b"fmt " and size >= 16:
            body = file.read(16)
            read += len(body)
            if len(body) == 16:
                kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body)
                form = (channels, rate, bits) if kind == 1 and bits in (8, 16) and channels and rate else None
        at += 8 + size + (size & 1)
    return None


def mono(raw: bytes, head: Header) -> np.ndarray:
    """Samples in [-1, 1], channels averaged."""
    whole = np.frombuffer(raw[: len(raw) // head.width * head.width], np.uint8 if head.bits == 8 else "<i2")
    wave = (whole.astype(np.float32) - 128) / 128 if head.bits == 8 else whole.astype(np.float32) / 32768
    return wave.reshape(-1, head.channels).mean(axis=1)


@dataclass
class Part(InputPartition):
    """The ``part``-th of ``parts`` shares of the byte ranges (or headers) of some files, or of those in a folder."""

    files: list[tuple[str, int]]
    part: int = 0
    parts: int = 1
    folder: str | None = None


class SoundReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.headers = options.get("read", "blocks") == "headers"
        self.block = int(options.get("block", BLOCK))
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.files_each = int(options.get("filesperpartition", 256))

    def _below(self, files: pafs.FileSystem, folder: str, deep: bool = False) -> list[tuple[str, int]]:
        found = files.get_file_info(pafs.FileSelector(folder, recursive=deep))
        return sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and x.extension.lower() == "wav")

    def _groups(self) -> list[tuple[Part, int, int]]:
        """Folders of a manifest, or files, packed: each with its number of files and its bytes."""
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [(Part([(path, info.size)]), 1, info.size)]
        if files.get_file_info(posixpath.join(path, MANIFEST)).type == pafs.FileType.File:
            # files of jobs that did not end are in no folder that is named
            named = json.loads(files.open_input_stream(posixpath.join(path, MANIFEST)).read())["folders"]
            return [(Part([], folder=posixpath.join(path, f)), n, size) for f, n, size in named]
        out: list[tuple[Part, int, int]] = []
        for name, size in self._below(files, path, deep=True):
            if out and out[-1][1] < self.files_each and out[-1][2] + size <= self.part_bytes:
                part, n, before = out[-1]
                part.files.append((name, size))
                out[-1] = part, n + 1, before + size
            else:
                out.append((Part([(name, size)]), 1, size))
        return out

    def partitions(self) -> list[Part]:
        """Shares of the groups by their sizes; no sound file is opened here."""
        groups = self._groups()
        count = lambda n, size: max(1, -(-n // self.files_each) if self.headers else -(-size // self.part_bytes))
        wanted = sum(count(n, size) for _, n, size in groups)
        most = max(SMALL_PARTS, sum(size for _, _, size in groups) // PART_BYTES)
        out = []
        for group, n, size in groups:
            parts = count(n, size) if wanted <= most else max(1, count(n, size) * most // wanted)
            out += [Part(group.files, i, parts, group.folder) for i in range(parts)]
        return out or [Part([])]

    def _ranges(self, files: pafs.FileSystem, partition: Part) -> list[tuple[str, int, int, int]]:
        """``path, size, part, parts``: the byte ranges of files that are the partition's."""
        found = partition.files if partition.folder is None else self._below(files, partition.folder)
        every = [(path, size, i, n) for path, size in found for n in [1 if self.headers else max(1, -(-size // self.part_bytes))] for i in range(n)]
        first, past = (len(every) * i // partition.parts for i in (partition.part, partition.part + 1))
        return every[first:past]

    def read(self, partition: Part) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for path, size, part, parts in self._ranges(files, partition):
            with files.open_input_file(path) as file:
                head = header(file, size)
                if self.headers:
                    if head is None:
                        yield path, None, None, None, 0, 0, min(size, 12)
                    else:
                        yield path, head.rate, head.channels, head.bits, head.frames, head.frames * 1_000_000 // head.rate, head.bytes_read
                elif head is None:
                    if part == 0:
                        yield path, None, None, None, None, None
                else:
                    yield from self._blocks(file, path, head, part, parts)

    def _blocks(self, file, path: str, head: Header, part: int, parts: int) -> Iterator[tuple]:
        count = -(-head.frames // self.block)
        first, past = (count * i // parts for i in (part, part + 1))
        for number in range(first, past):
            begin = number * self.block
            file.seek(head.at + begin * head.width)
            raw = file.read(min(self.block, head.frames - begin) * head.width)
            yield path, head.rate, head.channels, number, begin, mono(raw, head).tolist()


@dataclass
class Ended(WriterCommitMessage):
    """What a task wrote: its folders, each with its number of files and their bytes."""

    folders: list[tuple[str, int, int]]
    seconds: float


class SoundWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, f"job-{uuid.uuid4().hex}"
        lacking = [n for n in ("name", "rate", "samples") if n not in schema.names]
        if lacking:
            raise ValueError(f"rows to write as sound need {', '.join(lacking)}")

    def _at(self, *names: str) -> tuple[pafs.FileSystem, str]:
        files, path = opened(self.path)
        return files, posixpath.join(path, *names)

    def write(self, iterator: Iterator[Row]) -> Ended:
        """A file for each row, in folders of this run of the task; those of a run that is not counted are named nowhere."""
        files, _ = opened(self.path)
        folders: list[tuple[str, int, int]] = []
        seconds, names = 0, set()
        for row in iterator:
            if not row["name"] or "/" in row["name"] or row["rate"] is None or row["samples"] is None:
                raise ValueError(f"no sound file can be written for name {row['name']!r}")
            sound = wav_bytes(np.asarray(row["samples"], float), row["rate"])
            if not folders or row["name"] in names or folders[-1][1] >= FOLDER_FILES or folders[-1][2] + len(sound) > FOLDER_BYTES:
                folders.append((f"{self.job}/{uuid.uuid4().hex}", 0, 0))
                names = set()
                files.create_dir(self._at(folders[-1][0])[1], recursive=True)
            folder, n, size = folders[-1]
            with files.open_output_stream(self._at(folder, row["name"])[1]) as out:
                out.write(sound)
            names.add(row["name"])
            folders[-1] = folder, n + 1, size + len(sound)
            seconds += len(row["samples"]) / row["rate"]
        return Ended(folders, seconds)

    def _current(self) -> dict:
        files, path = self._at(MANIFEST)
        if files.get_file_info(path).type != pafs.FileType.File:
            return {"jobs": [], "folders": [], "files": 0, "seconds": 0.0}
        return json.loads(files.open_input_stream(path).read())

    def commit(self, messages: list[Ended | None]) -> None:
        """Point the manifest to the job's folder as well (or alone), by one move."""
        done = [m for m in messages if m is not None]
        now = self._current()
        old = now["jobs"] if self.overwrite else []
        kept = {"jobs": [], "folders": [], "files": 0, "seconds": 0.0} if self.overwrite else now
        folders = sorted(f for m in done for f in m.folders)
        jobs = kept["jobs"] + ([self.job] if folders else [])
        new = {"jobs": jobs, "folders": kept["folders"] + folders, "files": kept["files"] + sum(n for _, n, _ in folders), "seconds": round(kept["seconds"] + sum(m.seconds for m in done), 6)}
        files, path = self._at(f"_{self.job}.json")
        files.create_dir(posixpath.dirname(path), recursive=True)
        with files.open_output_stream(path) as out:
            out.write(json.dumps(new).encode())
        files.move(path, self._at(MANIFEST)[1])
        for job in old:
            files.delete_dir(self._at(job)[1])

    def abort(self, messages: list[Ended | None]) -> None:
        """Delete what the job wrote; the manifest stays as it was."""
        files, folder = self._at(self.job)
        if files.get_file_info(folder).type == pafs.FileType.Directory:
            files.delete_dir(folder)


class SoundFiles(DataSource):
    """The source and sink; see the module."""

    @classmethod
    def name(cls) -> str:
        return "quillon_sound"

    def schema(self) -> str:
        return HEADERS if self.options.get("read", "blocks") == "headers" else BLOCKS

    def reader(self, schema: StructType) -> SoundReader:
        return SoundReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> SoundWriter:
        return SoundWriter(dict(self.options), schema, overwrite)


def install(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(SoundFiles)


def header_of(data: bytes) -> Header | None:
    """The header of a file that is in memory."""
    return header(io.BytesIO(data), len(data))
