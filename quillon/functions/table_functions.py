"""Models as table functions: a table in, partitioned and ordered, rows out, callable from SQL.

``SELECT * FROM speaker_turns(TABLE(frames), 'rec', 'frame', 'spk', 10000)`` hands
each recording's frames in order to one instance of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType


def _given(table: AnalyzeArgument, *names: AnalyzeArgument) -> list[StructField]:
    """The named columns of the table argument; a column that it lacks is an error that names it."""
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    for name in names:
        if name.isConstantExpression is False or name.value not in table.dataType.names:
            raise ValueError(f"the table has no column {name.value!r}")
    return [table.dataType[n.value] for n in names]


@udtf
class SpeakerTurns:
    """Turns of a recording from labelled frames: what a diarizer gives.

    The table is partitioned by the key and ordered by the frame.  Frames without a
    speaker, and frames that are missing, end a turn.  Rows: the key (with its own
    type), ``turn, spk, s_us, e_us``.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, frame: AnalyzeArgument, spk: AnalyzeArgument, frame_us: AnalyzeArgument) -> AnalyzeResult:
        of_key, _, of_spk = _given(table, key, frame, spk)
        schema = StructType([StructField(key.value, of_key.dataType), StructField("turn", IntegerType()), StructField("spk", of_spk.dataType), StructField("s_us", LongType()), StructField("e_us", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(frame.value)], select=[SelectedColumn(key.value), SelectedColumn(frame.value), SelectedColumn(spk.value)])

    def __init__(self) -> None:
        self.turn = 0
        self.open: list | None = None
        self.frame_us = 0

    def _closed(self) -> Iterator[tuple]:
        if self.open:
            key, spk, first, past = self.open
            yield key, self.turn, spk, first * self.frame_us, past * self.frame_us
            self.turn, self.open = self.turn + 1, None

    def eval(self, row: Row, key: str, frame: str, spk: str, frame_us: int) -> Iterator[tuple]:
        self.frame_us = frame_us
        at, who = row[frame], row[spk]
        if self.open and (who != self.open[1] or at != self.open[3]):
            yield from self._closed()
        if who is not None:
            if self.open is None:
                self.open = [row[key], who, at, at]
            self.open[3] = at + 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()


@udtf
class ScoredChunks:
    """Transcribed chunks of a recording from its pieces: what a recognizer gives.

    Pieces (in order) are joined until `most` characters are reached; rows: the key,
    ``chunk, n, text, fill`` (share of `most`).  Pieces without text are counted only.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, text: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        of_key, _, of_text = _given(table, key, order, text)
        schema = StructType([StructField(key.value, of_key.dataType), StructField("chunk", IntegerType()), StructField("n", IntegerType()), StructField("text", of_text.dataType), StructField("fill", DoubleType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value), OrderingColumn(text.value)])

    def __init__(self) -> None:
        self.chunk, self.n, self.parts, self.held = 0, 0, [], None

    def eval(self, row: Row, key: str, order: str, text: str, most: int) -> Iterator[tuple]:
        self.most, self.key = most, row[key]
        self.n += 1
        if row[text]:
            self.parts.append(row[text])
        if sum(map(len, self.parts)) >= most:
            yield from self._closed()

    def _closed(self) -> Iterator[tuple]:
        if self.n:
            said = " ".join(self.parts)
            yield self.key, self.chunk, self.n, said, min(1.0, len(said) / self.most)
            self.chunk, self.n, self.parts = self.chunk + 1, 0, []

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()


def install(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    spark.udtf.register("speaker_turns", SpeakerTurns)
    spark.udtf.register("scored_chunks", ScoredChunks)
