"""Centroid clustering (operator 11): k-means by exponion search.

Every vector carries its centroid, an upper bound on the distance to it and a lower bound on the distance to any other. In each round
the bounds move with the centroids. A vector whose upper bound stays below the lower one, or below half the distance from its centroid to the
next one, keeps its centroid unread. Any other is measured against its own centroid (distance u) and, where that does not settle it, against the centroids inside the ball of
radius 2 u + s around its own one (s: the distance to the next centroid), read off the sorted list of inter-centroid distances. The ball holds
the nearest and the second nearest centroid; its radius is inclusive, so that centroids at equal distance are in it and the smaller number wins.

A vector is kept if it has the asked number of components, none null or not finite; components become integers floor(scale * x). Distances and sums of
integers are exact; only the bounds are floating-point numbers, and they are widened by far more than their rounding.

A round is one Arrow pass over the vectors and their bounds, written to the shared folder, and sums per task and centroid. The driver holds the k centroids alone.

Defined results: vectors with a component beyond +-``LARGEST`` after scaling are left out, as their squared distances need not fit a long (the sum over all is null where it does
not fit); repeated rows count each; a null id is clustered like any other but starts no cluster before all others; rows of equal hashes start
in the order of their vectors; fewer vectors than k give fewer centroids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, discard, in_batches

K, DIMS, SCALE, ROUNDS, SEED = 40, 64, 256.0, 5, 2
LARGEST = 1 << 27
#: Below this largest component, products of 64-bit floating-point numbers and their sums are exact.
EXACT = 1 << 21
#: Relative widening of the bounds.
SLACK = 1e-9
STATE = "vec_id long, vec binary, cluster int, distance long, upper double, lower double"


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances [vectors, centroids] of integer arrays."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        v, c = vectors.astype(float), centroids.astype(float)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = vectors - c
        out[:, j] = (d * d).sum(1)
    return out


class Centroids:
    """The centroids of a round: how far each moved, and each one's list of the others by distance."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now, self.k = now, len(now)
        moved = np.zeros(self.k) if before is None else np.sqrt(((now - before).astype(float) ** 2).sum(1))
        self.moved = moved * (1 + SLACK)
        first = int(self.moved.argmax())
        # The largest move among the others, by which lower bounds shrink.
        self.others_moved = np.full(self.k, self.moved[first])
        self.others_moved[first] = np.delete(self.moved, first).max(initial=0.0)
        apart = np.sqrt(squared(now, now).astype(float))
        self.order = np.argsort(apart, axis=1, kind="stable")
        # A centroid at the same place may come first in its list; the own one is always in the ball, as the ball holds all at distance 0.
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        np.fill_diagonal(apart, np.inf)
        self.next = apart.min(axis=1)


def nearest_two(distances: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, its distance, distance of the second nearest or the largest integer) of each row; of equals the smallest number."""
    at = np.lexsort((np.broadcast_to(numbers, distances.shape), distances), axis=1)
    rows = np.arange(len(distances))
    second = distances[rows, at[:, 1]] if distances.shape[1] > 1 else np.full(len(distances), np.iinfo(np.int64).max)
    return numbers[at[:, 0]], distances[rows, at[:, 0]], second


def assign(vectors: np.ndarray, c: Centroids, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """(cluster, squared distance, upper, lower, number of distances taken) of every vector; bounds are those of the round before, or None in the first."""
    n, numbers = len(vectors), np.arange(c.k)
    if cluster is None:
        new, d, second = nearest_two(squared(vectors, c.now), numbers)
        return new, d, np.sqrt(d.astype(float)) * (1 + SLACK), np.sqrt(second.astype(float)) * (1 - SLACK), n * c.k
    cluster = cluster.copy()
    upper = (upper + c.moved[cluster]) * (1 + SLACK)
    lower = (lower - c.others_moved[cluster]) * np.where(lower > c.others_moved[cluster], 1 - SLACK, 1 + SLACK)
    distance = np.full(n, -1, np.int64)
    taken = 0
    bound = np.maximum(lower, c.next[cluster] / 2 * (1 - SLACK))
    for j in np.unique(cluster[upper >= bound]):
        # Those that the bounds do not settle: the upper bound becomes the distance, then the ball is read.
        rows = np.flatnonzero((cluster == j) & (upper >= bound))
        distance[rows] = squared(vectors[rows], c.now[j : j + 1])[:, 0]
        taken += len(rows)
        upper[rows] = np.sqrt(distance[rows].astype(float)) * (1 + SLACK)
        rows = rows[upper[rows] >= bound[rows]]
        radius = (2 * upper[rows] + c.next[j]) * (1 + SLACK)
        inside = np.searchsorted(c.sorted[j], radius, "right")
        # Vectors whose balls hold about as many centroids (up to twice as many) are measured together.
        for size in np.unique(np.ceil(np.log2(np.maximum(inside, 1)))):
            part = np.ceil(np.log2(np.maximum(inside, 1))) == size
            mine, ball = rows[part], c.order[j, : inside[part].max()]
            d = squared(vectors[mine], c.now[ball])
            taken += d.size
            cluster[mine], distance[mine], second = nearest_two(d, ball)
            upper[mine] = np.sqrt(distance[mine].astype(float)) * (1 + SLACK)
            lower[mine] = np.sqrt(second.astype(float)) * (1 - SLACK)
    return cluster, distance, upper, lower, taken


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _round(centroids, dims: int, last: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            vectors = _vectors(batch.column(1), dims)
            bounds = [None] * 3 if batch.num_columns == 2 else [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4, 5)]
            cluster, distance, upper, lower, _ = assign(vectors, c, *bounds)
            if last:  # a settled vector's distance is still wanted
                for j in np.unique(cluster[distance < 0]):
                    rows = np.flatnonzero((cluster == j) & (distance < 0))
                    distance[rows] = squared(vectors[rows], c.now[j : j + 1])[:, 0]
            columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "cluster", "distance", "upper", "lower"])

    return run


def _sums(k: int, dims: int):
    """Per task, the number and the componentwise sums of each centroid's vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster = batch.column(1).to_numpy()
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, _vectors(batch.column(0), dims))
        some = np.flatnonzero(n)
        columns = [np.repeat(some, dims), np.tile(np.arange(dims), len(some)), np.repeat(n[some], dims), sums[some].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["cluster", "dim", "n", "total"])

    return run


def _packed(dims: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a : a + 4 * dims] for a in range(0, len(flat), 4 * dims)], pa.binary())], ["vec_id", "vec"])

    return run


def usable(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec array<int>) of the kept vectors."""
    scaled = lambda x: x * F.lit(float(scale))
    v = F.col(column).cast("array<double>")
    fits = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (scaled(x) >= -LARGEST) & (scaled(x) < LARGEST), F.lit(False)))
    kept = vectors.where(F.col(column).isNotNull() & (F.size(column) == dims) & fits)
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(scaled(x)).cast("int")).alias("vec"))


def starts(kept: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``; only these reach the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.orderBy(h.asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r.vec for r in rows], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: float = SCALE, seed: int = SEED, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): the clustering after so many rounds and a last assignment."""
    spark = vectors.sparkSession
    kept = usable(vectors, dims, scale, key, column)
    now, before = starts(kept, k, dims, seed), None
    state = in_batches(kept, _packed(dims), "vec_id long, vec binary")
    for r in range(rounds + 1 if len(now) else 0):
        centroids = spark.sparkContext.broadcast(Centroids(now, before))  # k rows
        after = cut(in_batches(state, _round(centroids, dims, r == rounds), STATE))
        if r:
            discard(state)
        state = after
        if r < rounds:
            sums = in_batches(state.select("vec", "cluster"), _sums(len(now), dims), "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            before, now = now, now.copy()
            for s in sums.collect():  # k x dims rows
                now[s["cluster"], s["dim"]] = s["total"] // s["n"]
    if not len(now):
        state = spark.createDataFrame([], STATE)
    per = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = per.agg(F.sum("s").alias("t"))
    centroid = spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(now)], "cluster int, centroid array<long>")
    # Both sides have a row a centroid.
    facts = centroid.join(per, "cluster").join(F.broadcast(total)).select("cluster", F.expr("try_cast(s as long)").alias("cluster_inertia"), F.expr("try_cast(t as long)").alias("inertia"), "centroid")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
