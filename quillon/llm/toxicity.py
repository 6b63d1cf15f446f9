"""Operator 3: toxicity by FTRL-proximal logistic regression.

Features are word unigrams, bigrams and skip-grams (one word left out), hashed
into 2**`BITS` coordinates; a feature counts once per document.  Training runs
in rounds: the labelled sample lies in `SHARDS` shards, each shard runs FTRL with
per-coordinate rates from the shared state, and the states of the active
coordinates are averaged over the shards (a coordinate that is not active in a
shard counts as zero there).  L1 keeps few coordinates active, so what is carried
between rounds and broadcast for scoring is small, and never more than
2**`BITS` numbers.

The threshold comes from cross-fitting: beside the model of the whole sample,
`PARTS` models leave out one part each and rate just that part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textnp as tn
from quillon.llm.frames import cut, discard, hidden, table

BITS = 22
ROUNDS = 3
#: Most shards, and documents that a shard has at least if there are so many.
SHARDS = 6
SHARD_ROWS = 2000
#: Parts of the sample; each is rated by a model that has not seen it, to place the bias.
PARTS = 5


@dataclass(frozen=True)
class Ftrl:
    """Rates of FTRL-proximal."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0


@dataclass(frozen=True)
class Model:
    """Active coordinates and their weights; the last coordinate is the bias."""

    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << BITS) + 1, np.float32)
        out[self.index] = self.weight
        return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the documents of a chunk, and the document of each (repeats included)."""
    lower = tn.LOWER[data]
    begin, end, start = tn.words(lower, offsets, tn.NOT_ALNUM)
    one = tn.span_hashes(lower, begin, end)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(start))
    parts, docs = [one], [doc]
    for gap, factor in ((1, 3), (2, 5)):
        if len(one) > gap:
            inside = doc[gap:] == doc[:-gap]
            parts.append(tn.mix(one[:-gap] * np.uint64(factor) + one[gap:])[inside])
            docs.append(doc[gap:][inside])
    hashed = np.concatenate(parts) >> np.uint64(64 - BITS)
    return hashed.astype(np.int64), np.concatenate(docs)


#: Of each model: coordinates, z and n.
State = tuple[np.ndarray, np.ndarray, np.ndarray]


def _coordinates(text: pa.ChunkedArray) -> list[np.ndarray]:
    """The distinct coordinates of each document, the bias last."""
    data, offsets = tn.binary_buffers(text)
    found = []
    for low, high in tn.chunks(offsets):
        hashed, doc = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        pairs = np.unique(doc << BITS | hashed)
        at = np.searchsorted(pairs, np.arange(high - low + 1) << BITS)
        hashed = (pairs & ((1 << BITS) - 1)).astype(np.int32)
        found += [np.append(hashed[a:z], np.int32(1 << BITS)) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return found


def _learn(documents: list[np.ndarray], labels: np.ndarray, settings: Ftrl, state: State) -> State:
    """One pass of FTRL over some documents; the active coordinates afterwards."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    z[state[0]], n[state[0]] = state[1], state[2]
    for i, label in zip(documents, labels.tolist(), strict=True):
        zi, ni = z[i], n[i]
        root = np.sqrt(ni)
        w = np.where(np.abs(zi) <= settings.l1, 0.0, (np.sign(zi) * settings.l1 - zi) / ((settings.beta + root) / settings.alpha + settings.l2))
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        z[i] += g - (np.sqrt(ni + g * g) - root) / settings.alpha * w
        n[i] += g * g
    active = np.flatnonzero(np.abs(z) > settings.l1)
    return active, z[active], n[active]


def _trainer(settings: Ftrl, states: list[State]):
    """One shard's pass for every model, over its documents in the order of their hash; model m leaves out part m."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["turn"].to_numpy(), kind="stable")))
        documents, labels, part = _coordinates(rows["text"]), rows["toxic"].to_numpy().astype(np.float64), rows["part"].to_numpy()
        out = []
        for model, state in enumerate(states):
            own = np.flatnonzero(part != model)
            idx, z, n = _learn([documents[i] for i in own.tolist()], labels[own], settings, state)
            out.append(pa.table({"model": pa.array(np.full(len(idx), model), pa.int32()), "idx": pa.array(idx, pa.int64()), "z": pa.array(z), "n": pa.array(n)}))
        return pa.concat_tables(out)

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 24_000, rounds: int = ROUNDS, settings: Ftrl = Ftrl()) -> Model:
    """Fit on at most about `train_rows` labelled rows, picked by a hash of their id.

    Rows that `held_out` marks, and labels or ids that are null, are left out; of
    several labels of one document the largest counts, rows that share an id have
    the same label.  L1 shrinks the weights and with them the scores of the rarer
    class, so the bias is placed afterwards, where it parts the classes best on
    scores of documents by models that have not seen them.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marked.count()
    share = min(1.0, train_rows / max(known, 1))
    turn = F.xxhash64("doc_id", F.lit(11))
    picked = marked.withColumn("turn", turn).filter(F.pmod("turn", F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.filter(~held_out()).select("doc_id", "text").join(picked, "doc_id")
    shards = max(1, min(SHARDS, int(known * share) // SHARD_ROWS))
    dealt = F.pmod(F.xxhash64("turn"), F.lit(PARTS * shards)).cast("int")
    sample = cut(texts.select((dealt % PARTS).alias("part"), F.floor(dealt / PARTS).cast("int").alias("shard"), "turn", "toxic", "text"))
    # one model for each part left out, and one that sees them all
    states = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * (PARTS + 1)
    for _ in range(rounds):
        passed = sample.groupBy("shard").applyInArrow(_trainer(settings, states), "model int, idx long, z double, n double")
        merged = passed.groupBy("model", "idx").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).orderBy("model", "idx").toPandas()
        states = [(m["idx"].to_numpy(np.int64), m["z"].to_numpy(np.float64), m["n"].to_numpy(np.float64)) for m in (merged[merged["model"] == i] for i in range(PARTS + 1))]
    fitted = [_weights(state, settings) for state in states]
    rated = _cross_scores(sample, fitted[:PARTS])
    discard(sample)
    return with_bias(fitted[PARTS], best_cut(rated["score"].to_numpy(np.float64), rated["toxic"].to_numpy() > 0))


def _weights(state: State, settings: Ftrl) -> Model:
    index, z, n = state
    on = np.abs(z) > settings.l1
    weight = (np.sign(z) * settings.l1 - z) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)
    return Model(index[on], weight[on].astype(np.float32))


def _cross_scores(sample: DataFrame, fitted: list[Model]):
    """``score, toxic`` of the sample's documents, each by the model that left out its part."""
    shared = sample.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            for i, model in enumerate(shared.value):
                own = batch.filter(pa.array(part == i))
                p = _chunk_scores(own.column(2), model.dense())
                yield pa.RecordBatch.from_arrays([pa.array(p), own.column(1)], ["score", "toxic"])

    return sample.select("part", "toxic", "text").mapInArrow(run, f"score double, toxic {sample.schema['toxic'].dataType.simpleString()}").toPandas()


def _chunk_scores(text: pa.Array, dense: np.ndarray) -> np.ndarray:
    """The scores of a column of texts, a chunk of documents at a time."""
    data, offsets = tn.binary_buffers(text)
    return np.concatenate([scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], dense) for a, b in tn.chunks(offsets)] or [np.zeros(0)])


def best_cut(p: np.ndarray, toxic: np.ndarray, alarm_cost: float = 3.0) -> float:
    """The log-odds that part the classes best; the middle of them if several do.

    A clean document that is rejected counts as `alarm_cost` toxic ones that pass.
    Where nothing toxic is told apart, as without labels, nothing is rejected.
    """
    odds = np.log(p) - np.log1p(-p)
    levels = np.append(np.unique(odds), odds.max() + 1 if len(odds) else 1.0)
    alarms = (~toxic).sum() - np.searchsorted(np.sort(odds[~toxic]), levels, side="left")
    misses = np.searchsorted(np.sort(odds[toxic]), levels, side="left") + alarm_cost * alarms
    best = np.flatnonzero(misses == misses.min())
    low = best[len(best) // 2]
    return float((levels[low] + levels[low - 1]) / 2) if low else float(levels[0])


def with_bias(model: Model, shift: float) -> Model:
    """The model with its bias lowered by `shift`."""
    plain = model.index < 1 << BITS
    bias = float(model.weight[~plain].sum()) - shift
    return Model(np.append(model.index[plain], 1 << BITS), np.append(model.weight[plain], np.float32(bias)))


def scores(data: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The probability of each document of a chunk."""
    hashed, doc = features(data, offsets)
    active = dense[hashed] != 0
    pairs = np.unique(doc[active] << BITS | hashed[active])
    total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], minlength=len(offsets) - 1) + float(dense[1 << BITS])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with columns ``score`` and ``predicted``; all input columns stay, whatever their names.

    Null and empty texts get the score of the bias.  Existing columns of those two
    names are replaced.  Equal texts get equal scores; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inputs, back = hidden(docs.drop("score", "predicted"), ["text"])
    text_at = inputs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = shared.value.dense()
        for batch in batches:
            p = _chunk_scores(batch.column(text_at), dense)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema)
    return inputs.mapInArrow(run, f"{kinds}, score double, predicted int").select(*back, "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every text of ``documents``, learnt from the rows of ``labels`` that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
