"""Where models plug in: families of functions by name, as Spark sees them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

# The model families.
FAMILIES = ("separator", "diarizer", "overlap", "embedder", "scorer", "transcriber")
_known: dict[tuple[str, str], Callable] = {}


def register(family: str, name: str, factory: Callable) -> None:
    """Add a factory; an unknown family is an error."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; families are {', '.join(FAMILIES)}")
    _known[family, name] = factory


def create(family: str, name: str, *args, **settings):
    """Make the named member of a family; the error lists the names there are."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    if (family, name) not in _known:
        names = sorted(n for f, n in _known if f == family)
        raise KeyError(f"no {family} named {name!r}; there are {', '.join(names) or 'none'}")
    return _known[family, name](*args, **settings)


def names(family: str) -> list[str]:
    return sorted(n for f, n in _known if f == family)


def cosine_scorer():
    """A pandas UDF that scores two embeddings; a pair it cannot score is null.

    It shows what a plugged-in scorer looks like; for cosines alone use `operators.vectors.cosine`.
    """

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        def one(x, y):
            if x is None or y is None or len(x) != len(y):
                return None
            x, y = np.asarray(x, float), np.asarray(y, float)
            lengths = np.sqrt(x @ x) * np.sqrt(y @ y)
            return float(x @ y / lengths) if lengths > 0 else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score


@udtf(returnType=StructType([StructField("chunk", IntegerType()), StructField("s_us", LongType()), StructField("e_us", LongType())]))
class Chunks:
    """Rows of the chunks that cover [0, total)."""

    def eval(self, total: int, chunk: int) -> Iterator[tuple[int, int, int]]:
        if total and total > 0:
            step = chunk if chunk > 0 else total
            for i, s in enumerate(range(0, total, step)):
                yield i, s, min(s + step, total)


def install(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    spark.udtf.register("chunks", Chunks)
    spark.udf.register("voice_score", create("scorer", "cosine"))


def map_model(rows: DataFrame, loader: Callable, apply: Callable, schema: str, or_none: bool = False) -> DataFrame:
    """Run a model over batches: loaded once in each task, `apply(model, batch)` gives a batch.

    With `or_none` a model that cannot be loaded is None, and `apply` says what that means.
    Turns of a diarizer and spans of a detector come out this way too: a batch of
    recordings in, a batch of rows out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = loader()
        except Exception:
            if not or_none:
                raise
            model = None
        for batch in batches:
            yield apply(model, batch)

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class Stage:
    """A named step over a table: `run(rows, settings)`; it is skipped unless `on(settings)`."""

    name: str
    run: Callable[[DataFrame, dict], DataFrame]
    needs: tuple[str, ...] = ()
    on: Callable[[dict], bool] = lambda settings: True


def run_stages(rows: DataFrame, stages: list[Stage], settings: dict) -> DataFrame:
    """The stages one after another as one plan; a setting that a stage needs and does not find is an error."""
    for stage in stages:
        if not stage.on(settings):
            continue
        lacking = [n for n in stage.needs if n not in settings]
        if lacking:
            raise KeyError(f"stage {stage.name!r} needs {', '.join(lacking)}")
        rows = stage.run(rows, settings)
    return rows


def unavailable(what: str) -> Callable:
    """A factory for a model that is not part of this library."""

    def make(*args, **settings):
        raise RuntimeError(f"{what} is not available: register a factory for it")

    return make


register("scorer", "cosine", cosine_scorer)
for _family in FAMILIES:
    if not names(_family):
        register(_family, "external", unavailable(f"a {_family}"))
