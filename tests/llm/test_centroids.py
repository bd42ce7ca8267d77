"""Clustering against plain Python, and the bounds that prune."""

import hashlib
import math
import random

import numpy as np
import pytest

from pitchlake.llm import centroids as C


def plain(rows, k, rounds, dims, scale=1024, seed=3):
    """[(vec_id, cluster, distance)], final centroids. rows: (vec_id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(math.floor(scale * x)) <= C.LARGEST for x in v)]
    order = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))
    middle = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else m for c, m in enumerate(middle)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=repr), middle


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")


def held(df):
    return sorted(((r.vec_id, r.cluster, r.distance) for r in df.collect()), key=repr)


def test_against_plain_python(spark):
    rng = random.Random(5)
    hubs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(hubs)]) for i in range(300)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (400, None), (401, []), (402, [1.0] * 5), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("nan")] + [0.0] * 5), (405, [float("inf")] + [0.0] * 5), (406, [3e38] * 6)]
    want, middle = plain(rows, 4, 5, 6)
    df = C.clusters(frame(spark, rows), 4, 5, 6)
    assert held(df) == want
    of = {}
    for _, c, d in want:
        of[c] = of.get(c, 0) + d
    for r in df.collect():
        assert r.cluster_inertia == of[r.cluster] and r.inertia == sum(of.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_ties_copies_and_few_vectors(spark):
    same = [(i, [0.5, -0.25]) for i in range(20)]  # equal vectors: all start centroids, all in the first
    assert held(C.clusters(frame(spark, same), 4, 3, 2)) == plain(same, 4, 3, 2)[0] == sorted(((i, 0, 0) for i in range(20)), key=repr)
    grid = [(i, [float(i % 3), float(i // 3)]) for i in range(9)]  # many equal distances
    assert held(C.clusters(frame(spark, grid), 3, 4, 2)) == plain(grid, 3, 4, 2)[0]
    few = [(1, [1.0, 1.0]), (2, [2.0, 2.0])]
    assert held(C.clusters(frame(spark, few), 8, 2, 2)) == plain(few, 8, 2, 2)[0]


def test_empty(spark):
    df = C.clusters(frame(spark, []), 8, 2, 2)
    assert df.count() == 0 and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert C.clusters(frame(spark, [(1, None)]), 8, 2, 2).count() == 0


@pytest.mark.parametrize("largest", [4, 1024, C.LARGEST])
def test_bounds_hold_and_prune(largest):
    rng = np.random.default_rng(1)
    hubs = rng.integers(-largest // 2, largest // 2 + 1, (8, 16))
    v = np.clip(hubs[rng.integers(0, 8, 2000)] + rng.integers(-max(1, largest // 40), max(1, largest // 40) + 1, (2000, 16)), -largest, largest).astype(np.int64)
    pivots, middle = C.far_apart(v[:256], 6), v[rng.choice(2000, 8, False)]
    to, of, between = C.squared(v, pivots), C.squared(middle, pivots), C.squared(pivots, pivots)
    true = C.squared(v, middle)
    bound = C.ptolemaic(to, of, between)
    assert (bound**2 <= true.astype(float) * (1 + 1e-15)).all() and (bound >= 0).all() | (bound.max() > 0)
    near, best, done = C.assign(v, to, middle, of, between)
    assert (near == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    assert done < 0.6 * true.size


def test_points_that_are_pivots():
    v = np.array([[0, 0], [10, 0], [0, 10], [10, 10]], np.int64)
    near, best, _ = C.assign(v, C.squared(v, v), v, C.squared(v, v), C.squared(v, v))
    assert near.tolist() == [0, 1, 2, 3] and not best.any()
