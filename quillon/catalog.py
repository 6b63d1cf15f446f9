"""The registered queries of the speech-corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import audio_queries, corpus_queries, detector_queries, extraction, interval_queries, model_queries, review_queries, sound_queries, stream_queries, text_queries, vector_queries, verification_queries

FLAGSHIP = "dataset_metadata"

_MODULES = (text_queries, interval_queries, vector_queries, corpus_queries, stream_queries, audio_queries, review_queries, extraction, detector_queries, model_queries, sound_queries, verification_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}

ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
