"""Exponion clustering against plain k-means on integers."""

import hashlib
import math

import numpy as np
import pytest

from pagemill.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k, dims, rounds, scale=256.0):
    """Every vector against every centroid, with Python integers."""
    ok = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if ok(v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    now = [v for _, v in sorted(kept, key=key)[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min((d2(v, c), j) for j, c in enumerate(now)) for _, v in kept]
        if r < rounds:
            groups = [[v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j] for j in range(len(now))]
            now = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, now, strict=True)]
    each = {j: sum(d for d, a in at if a == j) for j in range(len(now))}
    return sorted(((i is None, i or 0), j, d, each[j], sum(each.values()), tuple(now[j])) for (i, _), (d, j) in zip(kept, at, strict=True))


def ours(spark, rows, k, dims, rounds, parts=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(parts)
    out = clusters.cluster(df, k, dims, rounds).collect()
    return sorted(((r.vec_id is None, r.vec_id or 0), r["cluster"], r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_plain_with_many_ties(spark, seed):
    # A coarse grid: most distances tie, rows repeat, and clusters run empty.
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-2, 3, 3) / 256).tolist()) for i in rng.integers(0, 60, 80)]
    assert ours(spark, rows, 12, 3, 4) == plain(rows, 12, 3, 4)


def test_equals_plain_on_groups(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 8)) * 3
    rows = [(i, (middle[i % 20] + rng.normal(size=8) * 0.1).tolist()) for i in range(400)]
    assert ours(spark, rows, 20, 8, 5) == plain(rows, 20, 8, 5)


def test_large_components_are_exact(spark):
    rows = [(i, [x * 3.0e4, -x * 1.7e5, 400_000.0 - i]) for i, x in enumerate(np.linspace(-1, 1, 40).tolist())]
    assert ours(spark, rows, 5, 3, 3) == plain(rows, 5, 3, 3)


def test_what_takes_no_part(spark):
    good = [(1, [0.5, 1.0]), (None, [0.25, 0.25]), (1, [0.5, 1.0]), (7, [3.0, 1.0])]
    bad = [(2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("-inf")]), (8, []), (9, [1.0, 1.0, 1.0])]
    assert ours(spark, good + bad, 3, 2, 2) == plain(good, 3, 2, 2)
    assert ours(spark, good + [(10, [1e300, 0.0])], 3, 2, 2) == plain(good, 3, 2, 2)


def test_empty_and_single(spark):
    assert ours(spark, [], 4, 2, 2) == []
    assert ours(spark, [(3, [1.0, 2.0])], 4, 2, 2) == plain([(3, [1.0, 2.0])], 4, 2, 2)
    assert ours(spark, [(3, [1.0, 2.0]), (4, [1.0, 9.0])], 1, 2, 2) == plain([(3, [1.0, 2.0]), (4, [1.0, 9.0])], 1, 2, 2)


def test_bounds_and_balls_spare_distances():
    rng = np.random.default_rng(3)
    middle = rng.integers(-4000, 4000, (50, 2))
    vectors = (middle[rng.integers(0, 50, 3000)] + rng.integers(-30, 30, (3000, 2))).astype(np.int64)
    before, now, bounds, taken = None, middle.astype(np.int64), (None, None, None), []
    for _ in range(5):
        cluster, distance, upper, lower, n = clusters.assign(vectors, clusters.Centroids(now, before), *bounds)
        full = clusters.squared(vectors, now)
        assert (cluster == full.argmin(1)).all()
        assert (upper >= np.sqrt(full.min(1))).all() and (lower <= np.sqrt(np.partition(full, 1, axis=1)[:, 1])).all()
        bounds, before, now = (cluster, upper, lower), now, now.copy()
        taken.append(n)
        for j in np.unique(cluster):
            now[j] = vectors[cluster == j].sum(0) // (cluster == j).sum()
    assert taken[0] == 3000 * 50 and max(taken[1:]) < 3000 * 50 / 5
