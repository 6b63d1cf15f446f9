"""Verification of speakers by several models: each in its own space, with a prototype of its own.

A model is a function from samples to a vector.  Models of different spaces never
meet: a clip's vector of a model is compared with the target's prototype of the
same model.  Scores go into slots with fixed weights; two slots may name the same
model, and then share its vector and its prototype.  A model that fails on a clip
leaves its slots without a score, and the other weights are brought to one again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import fusion as fu
from quillon.operators import vectors as ve
from quillon.plans.shared import split_join

Model = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Slot:
    """A component of the fused score: its name, the model that fills it, its weight."""

    name: str
    model: str
    weight: float


#: Names and weights of the components; both outer ones are the same model unless given.
SLOTS = (Slot("rvector", "rvector", 0.4), Slot("ecapa", "ecapa", 0.3), Slot("gemini", "rvector", 0.3))


def one_model(name: str, slots: tuple[Slot, ...] = SLOTS, filled: tuple[str, ...] = ("rvector", "gemini")) -> tuple[Slot, ...]:
    """The slots with those in `filled` taken by a model that stands in for theirs; weights stay."""
    return tuple(Slot(s.name, name if s.name in filled else s.model, s.weight) for s in slots)


def embedded(clips: DataFrame, models: dict[str, Model], samples: str = "samples") -> DataFrame:
    """`clips` without the samples, with ``voices`` (model: vector) and ``failures`` (model: why there is none).

    Samples are read once for all models.  A model that raises, or whose vector is
    empty, has a component that is not finite, or has no length, has failed on the clip;
    the clip stays.  Clips without samples fail with every model.
    """
    kept = [f for f in clips.schema if f.name != samples]

    def voice(model: Model, wave) -> np.ndarray:
        if wave is None or not len(wave):
            raise ValueError("no samples")
        found = np.asarray(model(np.asarray(wave, float)), float)
        if found.ndim != 1 or not found.size or not np.isfinite(found).all() or not found.any():
            raise ValueError("no voice print")
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            voices, failures = [], []
            for wave in batch[samples]:
                got, lost = {}, {}
                for name, model in models.items():
                    try:
                        got[name] = voice(model, wave).tolist()
                    except Exception as error:  # a model may fail in any way; the clip stays and says why
                        lost[name] = str(error) or type(error).__name__
                voices.append(got)
                failures.append(lost)
            yield batch.drop(columns=[samples]).assign(voices=voices, failures=failures)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["voices map<string,array<double>>", "failures map<string,string>"])
    return clips.mapInPandas(run, schema)


def prototypes(references: DataFrame, target: str) -> DataFrame:
    """``target, model, n, centroid``: the mean of the normalised vectors of a target's reference clips, in each model's space.

    Clips on which a model failed do not count for it; a target that has none for a model has no prototype there.
    """
    return ve.centroid(references.select(target, F.explode("voices").alias("model", "v")), [target, "model"])


def scored(clips: DataFrame, found: DataFrame, target: str, by: str, slots: tuple[Slot, ...] = SLOTS) -> DataFrame:
    """`clips` with ``scores`` (slot: similarity to the claimed target's prototype in the slot's space).

    A slot is left out where the model failed, where the target has no prototype, or
    where the two have different lengths.  A target that a third of all clips claim is
    split by a hash of the column `by`.
    """
    packed = found.groupBy(target).agg(F.map_from_entries(F.collect_list(F.struct("model", "centroid"))).alias("prototypes_"))
    met = split_join(clips, packed, target, by, how="left")

    def similarity(slot: Slot) -> Column:
        a, b = (F.try_element_at(c, F.lit(slot.model)) for c in ("voices", "prototypes_"))
        return F.when(F.size(a) == F.size(b), ve.cosine(a, b))

    entries = F.array(*[F.struct(F.lit(s.name).alias("slot"), similarity(s).alias("score")) for s in slots])
    return met.withColumn("scores", F.map_from_entries(F.filter(entries, lambda x: x["score"].isNotNull()))).drop("prototypes_")


def verified(rows: DataFrame, factor: Column, slots: tuple[Slot, ...] = SLOTS, strategy: str = "weighted_average") -> DataFrame:
    """Adds ``score``: the slots fused with their weights (or the mean of the positive ones), times the factor; 0 without any."""
    parts = [F.try_element_at("scores", F.lit(s.name)) for s in slots]
    ways = {"weighted_average": lambda: fu.weighted(parts, factor, tuple(s.weight for s in slots)), "positive_mean": lambda: fu.positive_mean(parts, factor)}
    if strategy not in ways:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(ways)}")
    return rows.withColumn("score", ways[strategy]())
