"""Voice prints: normalised centroids, guarded cosine, identification by argmax."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def normalised(a: Column) -> Column:
    """The vector at length 1; raises on a vector without length."""
    length = norm(a)
    unit = F.transform(a, lambda x: x / length)
    return F.when(length > 0, unit).otherwise(F.raise_error(F.lit("a voice print has no length")).cast("array<double>"))


def centroid(vectors: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """Mean of the normalised vectors of each key (``keys, n, centroid``); the mean itself is not normalised.

    Averages run by position, so partial sums combine before the shuffle and no
    group of vectors is gathered.
    """
    units = vectors.select(*keys, F.posexplode(normalised(F.col(vector))).alias("pos", "x"))
    means = units.groupBy(*keys, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(ordered, lambda p: p["x"]).alias("centroid"))


#: Prototypes that are broadcast at once; more are taken in blocks.
BLOCK_PROTOTYPES = 4096


def _blocks(prototypes: DataFrame, label: str) -> list[DataFrame]:
    """Prototypes in blocks of about `BLOCK_PROTOTYPES`, so that the size of each is bounded."""
    n = max(1, -(-prototypes.count() // BLOCK_PROTOTYPES))
    return [prototypes.filter(F.pmod(F.xxhash64(label), F.lit(n)) == i) for i in range(n)] if n > 1 else [prototypes]


def similarities(vectors: DataFrame, prototypes: DataFrame, vector: str = "v", prototype: str = "centroid") -> DataFrame:
    """Every vector with every prototype.

    Prototypes are a query set (one a speaker); they are broadcast in blocks of a
    checked size, and vectors are not shuffled for them.
    """
    label = next(c for c in prototypes.columns if c != prototype)
    parts = [vectors.join(F.broadcast(block), how="cross") for block in _blocks(prototypes, label)]
    return reduce(DataFrame.unionByName, parts).withColumn("similarity", cosine(F.col(vector), F.col(prototype)))


def identify(scored: DataFrame, keys: list[str], label: str, score: str = "similarity") -> DataFrame:
    """The best label of each key, the least label on ties; null if all scores are exactly 0."""
    best = scored.groupBy(*keys).agg(F.min_by(F.struct(label, score), F.struct(-F.col(score), F.col(label))).alias("best"), F.bool_and(F.col(score) == 0).alias("none"))
    return best.select(*keys, F.when(~F.col("none"), F.col(f"best.{label}")).alias(label), F.col(f"best.{score}").alias(score))


def nearest(vectors: DataFrame, prototypes: DataFrame, label: str, vector: str = "v", prototype: str = "centroid") -> DataFrame:
    """Adds the best `label` of each vector and its ``similarity``, as `identify` does, without a row for each pair.

    The prototypes of a block are one array, broadcast, and the best is taken in the vector's own row.
    """
    found, rows = [], vectors
    for i, block in enumerate(_blocks(prototypes, label)):
        packed = block.agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col(prototype).alias("p"))).alias(f"block_{i}"))
        rows = rows.join(F.broadcast(packed), how="cross")
        alike = F.transform(f"block_{i}", lambda x: F.struct(cosine(F.col(vector), x["p"]).alias("s"), x["label"].alias("label")))
        ordered = F.transform(alike, lambda x: F.struct((-x["s"]).alias("order"), x["label"].alias("label"), x["s"].alias("s")))
        rows = rows.withColumn(f"best_{i}", F.struct(F.array_min(ordered).alias("best"), F.forall(ordered, lambda x: x["s"] == 0).alias("none"))).drop(f"block_{i}")
        found.append(F.col(f"best_{i}"))
    best = F.array_min(F.array(*[x["best"] for x in found]))
    none = reduce(lambda a, b: a & b, [x["none"] for x in found])
    return rows.select(*vectors.columns, F.when(~none, best["label"]).alias(label), best["s"].alias("similarity"))


def talk_time_prefix(turns: DataFrame, keys: list[str], seconds: float = 20.0) -> DataFrame:
    """A speaker's first turns until so many seconds are gathered; the turn that crosses is taken too."""
    before = Window.partitionBy(*keys).orderBy("s_us", "e_us", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    gathered = F.coalesce(F.sum(F.col("e_us") - F.col("s_us")).over(before), F.lit(0))
    return turns.withColumn("before_us", gathered).filter(F.col("before_us") < int(seconds * 1_000_000))
