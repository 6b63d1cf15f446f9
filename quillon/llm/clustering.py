"""Operator 11: exact k-means with Shallot search.

Vectors travel in blocks (`BLOCK` of them in a row), each with its nearest and its
second-nearest centroid, an upper bound of the distance to the first and a lower
bound of the distance to all others.  When centroids have moved, bounds are
widened by how far.  Where they still part, nothing is computed.  Else the
distances to both remembered centroids are, the scan starts from the closer one,
and goes through its neighbours by distance.  A neighbour further from it than
``d(x, start) + d(x, second)`` is further from x than the second, so the ball ends
the scan, and it shrinks with every closer second that is found.  Survivors are
compared by exact integer distances.

A round is one narrow pass over the blocks.  What clusters gained and lost in it is
summed in the tasks (work follows the vectors that moved), stands beside the
blocks in the same written table and is added up by Spark, so the driver sees
``k * (components + 1)`` sums a round, and a lost executor costs its tasks of one
round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.frames import cut, discard, table

#: Vectors in a block.
BLOCK = 1024
#: The greatest integer component: 64 squares of differences then fit a long, as do sums of a hundred billion.
GREATEST = 1 << 26
#: Bounds are kept as floats; what rounding may take is given back.
SLACK = 1e-12

_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("nearest", pa.binary()), ("second", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("gained", pa.list_(pa.int64()))])
_STATE_DDL = "ids array<long>, points binary, nearest binary, second binary, upper binary, lower binary, gained array<long>"


@dataclass
class Centroids:
    """Integer centroids, their distances, every one's others by distance, and half the way to the closest."""

    points: np.ndarray
    apart: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Centroids:
        k = len(points)
        apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2).astype(np.float64))
        order = np.argsort(np.where(np.eye(k, dtype=bool), -1.0, apart), axis=1, kind="stable")[:, 1:]
        half = np.take_along_axis(apart, order[:, :1], axis=1)[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        return cls(points, apart, order, half)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    gap = points - centroids
    return np.einsum("ij,ij->i", gap, gap)


def search(points: np.ndarray, nearest: np.ndarray, second: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second-nearest centroid of every row with squared distances, from two that are remembered.

    Ties go to the smaller number.
    """
    first_sq, next_sq = squared(points, now.points[nearest]), squared(points, now.points[second])
    swap = (next_sq < first_sq) | ((next_sq == first_sq) & (second < nearest))
    best, runner = np.where(swap, second, nearest), np.where(swap, nearest, second)
    best_sq, runner_sq = np.where(swap, next_sq, first_sq), np.where(swap, first_sq, next_sq)
    start, known, reach = best.copy(), runner.copy(), np.sqrt(best_sq.astype(np.float64))
    alive = np.arange(len(points))
    for j in range(now.others.shape[1]):
        other = now.others[start[alive], j]
        ball = (reach[alive] + np.sqrt(runner_sq[alive].astype(np.float64))) * (1 + SLACK)
        inside = now.apart[start[alive], other] <= ball
        alive, other = alive[inside], other[inside]
        if not len(alive):
            break
        fresh = other != known[alive]
        at, c = alive[fresh], other[fresh]
        sq = squared(points[at], now.points[c])
        wins = (sq < best_sq[at]) | ((sq == best_sq[at]) & (c < best[at]))
        closer = ~wins & (sq < runner_sq[at])
        w, r = at[wins], at[closer]
        runner[w], runner_sq[w] = best[w], best_sq[w]
        best[w], best_sq[w] = c[wins], sq[wins]
        runner[r], runner_sq[r] = c[closer], sq[closer]
    return best, runner, best_sq, runner_sq


def advance(points: np.ndarray, state: tuple | None, before: np.ndarray | None, now: Centroids) -> tuple:
    """The state ``nearest, second, upper, lower`` of a block after centroids moved from `before` to `now`."""
    n, k = len(points), len(now.points)
    if k == 1:
        zero = np.zeros(n, np.int32)
        return zero, zero, np.full(n, np.inf), np.full(n, np.inf)
    if state is None:
        zero = np.zeros(n, np.int32)
        best, runner, best_sq, runner_sq = search(points, zero, zero + 1, now)
        return best.astype(np.int32), runner.astype(np.int32), np.sqrt(best_sq.astype(np.float64)) * (1 + SLACK), np.sqrt(runner_sq.astype(np.float64)) * (1 - SLACK)
    nearest, second, upper, lower = (x.copy() for x in state)
    moved = np.sqrt(squared(now.points, before).astype(np.float64))
    most = np.sort(moved)[-2:]
    # the furthest way that any other centroid went
    others_moved = np.where(moved == most[1], most[0] if (moved == most[1]).sum() == 1 else most[1], most[1])
    upper += moved[nearest] * (1 + SLACK)
    lower -= others_moved[nearest] * (1 + SLACK)
    bound = np.maximum(lower, now.half[nearest] * (1 - SLACK))
    at = np.flatnonzero(upper >= bound)
    if len(at):
        upper[at] = np.sqrt(squared(points[at], now.points[nearest[at]]).astype(np.float64)) * (1 + SLACK)
        at = at[upper[at] >= bound[at]]
    if len(at):
        best, runner, best_sq, runner_sq = search(points[at], nearest[at], second[at], now)
        nearest[at], second[at] = best, runner
        upper[at] = np.sqrt(best_sq.astype(np.float64)) * (1 + SLACK)
        lower[at] = np.sqrt(runner_sq.astype(np.float64)) * (1 - SLACK)
    return nearest, second, upper, lower


def _unpacked(row: dict, components: int) -> tuple[np.ndarray, tuple | None]:
    points = np.frombuffer(row["points"], np.int32).reshape(-1, components).astype(np.int64)
    if row["nearest"] is None:
        return points, None
    kinds = (("nearest", np.int32), ("second", np.int32), ("upper", np.float64), ("lower", np.float64))
    return points, tuple(np.frombuffer(row[c], kind) for c, kind in kinds)


def _packer(components: int, scale: int) -> Callable:
    """Integer components in blocks; batches have ``id, vector``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(values * scale).reshape(-1, components)
            if len(whole) and np.abs(whole).max() > GREATEST:
                raise ValueError(f"a component times {scale} exceeds {GREATEST}; distances would not fit a long")
            points = whole.astype(np.int32)
            rows = [{"ids": ids[i : i + BLOCK], "points": points[i : i + BLOCK].tobytes()} for i in range(0, len(ids), BLOCK)]
            yield pa.RecordBatch.from_pylist(rows, _STATE)

    return run


def _rounds(before: np.ndarray | None, now: Centroids, components: int) -> Callable:
    """One round: blocks with their new state, and at the end what each cluster gained in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.points)
        gained = np.zeros((k, components + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                points, state = _unpacked(row, components)
                after = advance(points, state, before, now)
                at = np.arange(len(points)) if state is None else np.flatnonzero(after[0] != state[0])
                ones = np.concatenate([points[at], np.ones((len(at), 1), np.int64)], axis=1)
                np.add.at(gained, after[0][at], ones)
                if state is not None:
                    np.subtract.at(gained, state[0][at], ones)
                names = ("nearest", "second", "upper", "lower")
                yield pa.RecordBatch.from_pylist([{"ids": row["ids"], "points": row["points"]} | {c: x.tobytes() for c, x in zip(names, after, strict=True)}], _STATE)
        yield pa.RecordBatch.from_pylist([{"gained": gained.ravel().tolist()}], _STATE)

    return run


def _assigned(now: Centroids, before: np.ndarray, components: int) -> Callable:
    """The last assignment: a row a vector, with its exact distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points, state = _unpacked(row, components)
                nearest = advance(points, state, before, now)[0]
                distance = squared(points, now.points[nearest])
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return run


def _gained(state: DataFrame, k: int, components: int) -> np.ndarray:
    """Sums over all tasks; as many rows come to the driver as the centroids have components."""
    rows = state.filter("gained is not null").select(F.posexplode("gained").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(k * (components + 1), np.int64)
    for row in rows:
        out[row["at"]] = row["n"]
    return out.reshape(k, components + 1)


def kept_vectors(vectors: DataFrame, id_column: str, vector_column: str, components: int) -> DataFrame:
    """``id, vector`` of the vectors with exactly so many components, none of them null or not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    slim = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return slim.filter((F.size("vector") == components) & F.forall("vector", fine))


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """Exact k-means on ``floor(scale * x)``: the cluster of every vector after `rounds` rounds.

    Centroids start as the `k` vectors with the least lowercase-hex sha256 of `salt`
    and the id (decimal).  A round assigns every vector to the nearest centroid
    (squared Euclidean distance; ties: smaller number) and replaces non-empty
    centroids by the componentwise floor of their vectors' mean; empty ones stay.
    Returns ``id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors that are null, have another number of components or one that is null or
    not finite are left out.  Other columns are ignored, whatever their names.  Rows
    that share an id are vectors of their own, and equal ids start in the order of
    their components.  A null id hashes as `salt` alone.  With fewer vectors than
    `k` there are as many centroids; an empty table gives an empty result.  A
    component beyond `GREATEST` raises.  The centroids (``k * components`` integers)
    are what the driver holds and tasks are given.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_column, vector_column, components)
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.withColumn("name", name).orderBy("name", "vector").limit(k).select("vector").collect()
    if not first:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    points = np.array([[int(np.floor(x * scale)) for x in r["vector"]] for r in first], dtype=object)
    if np.abs(points).max() > GREATEST:
        raise ValueError(f"a component times {scale} exceeds {GREATEST}; distances would not fit a long")
    now, before = Centroids.of(points.astype(np.int64)), None
    state = kept.mapInArrow(_packer(components, scale), _STATE_DDL)
    sums = np.zeros((len(first), components + 1), np.int64)
    written: DataFrame | None = None
    for _ in range(rounds):
        new = cut(state.mapInArrow(_rounds(before, now, components), _STATE_DDL))
        sums += _gained(new, len(first), components)
        if written is not None:
            discard(written)
        written = new
        state = new.filter("points is not null")
        moved = np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), now.points)
        before, now = now.points, Centroids.of(moved)
    last = cut(state.mapInArrow(_assigned(now, before, components), "id long, cluster int, distance long"))
    if written is not None:
        discard(written)
    inertia = {r["cluster"]: r["n"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(now.points.tolist())]
    # one row a centroid
    return last.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all ``embeddings`` in 8 clusters after 10 rounds."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


def _op11_sql(k: int = 8, rounds: int = 10, components: int = 64) -> str:
    steps = [
        f"kept as materialized (select vec_id, row_number() over (order by vec_id) as row_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v from embeddings where len(embedding) = {components} and len([x for x in embedding if isfinite(x)]) = {components})",
        f"c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id)) - 1 as int) as c, v from kept order by sha256('3:' || vec_id) limit {k})",
    ]
    pick = "select row_id, vec_id, v, c, d from (select t.row_id, t.vec_id, t.v, c{r}.c, cast(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(t.v, c{r}.v)]) as bigint) as d from kept t cross join c{r}) qualify row_number() over (partition by row_id order by d, c) = 1"
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({pick.format(r=r)})")
        steps.append(f"s{r} as materialized (select c, i, cast(floor(sum(x) / count(*)) as bigint) as rough, cast(sum(x) as bigint) as total, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by c, i)")
        # the quotient may be off by one; the remainder tells
        exact = "rough + case when total - rough * n < 0 then -1 when total - rough * n >= n then 1 else 0 end"
        steps.append(f"c{r + 1} as materialized (select p.c, coalesce(m.v, p.v) as v from c{r} p left join (select c, list({exact} order by i) as v from s{r} group by c) m using (c))")
    steps.append(f"last as materialized ({pick.format(r=rounds)})")
    return f"with {', '.join(steps)} select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256 from last join c{rounds} using (c)"


#: Every round is a pair of steps.
OP11_SQL = _op11_sql()
