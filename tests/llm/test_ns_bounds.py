"""Clusters against plain rounds in Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from prismdex.llm import ns_bounds as N

DATA = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int, cluster int, distance string, x long"


def floors(x, scale):
    return [math.floor(v * scale) if abs(v) < 2 ** 53 else int(v) * scale for v in x]


def brute(vectors, s):
    kept = [(i, floors(v, s.scale)) for i, v in vectors
            if v is not None and len(v) == s.dim and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:s.clusters]
    centroids = [v for _, v in starts]
    if not centroids:
        return [], []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(s.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr), centroids


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "d", 3) for i, v in vectors], VECTORS)


def found(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in df.collect()), key=repr)


def noise(n, dim, seed=0, scale=1.0):
    return [(i, (np.random.default_rng([seed, i]).normal(size=dim) * scale).tolist()) for i in range(n)]


def test_given_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    rows, centroids = brute(vectors, N.Settings())
    got = N.op13_ns_bounds(table.repartition(3)).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == rows
    assert {r["inertia"] for r in got} == {sum(d for *_, d in rows)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in rows if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 7])
def test_groups_ties_and_partitions(spark, parts):
    """Few values on a grid: ties in most rows, clusters that run empty, and copies."""
    s = N.Settings(clusters=6, rounds=8, dim=3, scale=2)
    grid = np.random.default_rng(5).integers(-2, 3, (400, 3)) / 2
    vectors = [(i % 390, v.tolist()) for i, v in enumerate(grid)]
    got, history, _ = N.cluster(frame(spark, vectors).repartition(parts), s)
    rows, centroids = brute(vectors, s)
    assert found(got) == rows and history[-1].tolist() == centroids and len(history) == s.rounds + 1


def test_bounds_spare_measurements(spark):
    s = N.Settings(clusters=8, rounds=6, dim=4)
    at = np.random.default_rng(1).normal(size=(8, 4)) * 20
    vectors = [(i, (at[i % 8] + np.random.default_rng([2, i]).normal(size=4)).tolist()) for i in range(800)]
    got, _, measured = N.cluster(frame(spark, vectors), s)
    assert found(got) == brute(vectors, s)[0]
    assert measured[0] == 800 * 8 and all(n < 800 * 8 / 3 for n in measured[2:])


def test_loosened_bounds_hold_and_beat_summed_drifts():
    """Stored bounds less the norm of the total displacement, over a centroid that comes and goes."""
    v = np.array([[0, 0], [100, 0]])
    history = [np.array([[10, 0], [500, 0]]), np.array([[10, 300], [900, 0]]), np.array([[10, 0], [480, 0]])]
    first = N.Bounds(history[:1]).first(v)
    bounds = N.Bounds(history)
    assert bounds.moved[0].tolist() == [0.0, 20.0]  # 600 and 820 by summed drifts
    cluster, far, at, measured = bounds.assign(v, *first[:3])
    assert cluster.tolist() == [0, 0] and measured.tolist() == [0, 0] and at.tolist() == [[0, 0], [0, 0]]


def test_every_bound_is_true(spark):
    rng = np.random.default_rng(9)
    v = rng.integers(-500, 500, (300, 5))
    history = [rng.integers(-500, 500, (4, 5))]
    cluster, far, at, _ = N.Bounds(history).first(v)
    for _ in range(12):
        history.append(history[-1] + rng.integers(-60, 60, (4, 5)))
        bounds = N.Bounds(history)
        cluster, far, at, _ = bounds.assign(v, cluster, far, at)
        true = np.sqrt(np.stack([N.squared(v, c) for c in history[-1]], 1))
        assert (cluster == (true ** 2).round().argmin(1)).all()
        assert (far - bounds.moved[at, np.arange(4)] <= true + 1e-6).all() and (far + bounds.moved[at, np.arange(4)] >= true - 1e-6).all()


def test_unusable_vectors(spark):
    s = N.Settings(clusters=3, rounds=3, dim=2)
    vectors = noise(30, 2) + [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [1.0, float("inf")]),
                              (106, [0.0, 0.0]), (None, [0.5, 0.5]), (3, [9.0, 9.0]), (3, [9.0, 9.0]), (107, [1.0, 2.0, 3.0])]
    got, _, _ = N.cluster(frame(spark, vectors), s)
    rows = found(got)
    assert rows == brute(vectors, s)[0] and len(rows) == 34


def test_fewer_vectors_than_clusters_and_none(spark):
    vectors = noise(3, 64)
    got = N.op13_ns_bounds(frame(spark, vectors)).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == brute(vectors, N.Settings())[0]
    empty = N.op13_ns_bounds(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert N.op13_ns_bounds(frame(spark, [(None, [0.5] * 64)])).collect() == []


def test_wide_components_are_exact(spark):
    s = N.Settings(clusters=3, rounds=4, dim=2)
    vectors = noise(20, 2, scale=1e6) + [(50, [2.0 ** 60, -2.0 ** 60]), (51, [1e18, 3.0]), (52, [-0.3, 1e15 + 0.5])]
    got, _, _ = N.cluster(frame(spark, vectors), s)
    rows = [(i, j, d if d < 2 ** 63 else None) for i, j, d in brute(vectors, s)[0]]
    assert found(got) == rows and None in {d for *_, d in rows}
    wide = N.op13_ns_bounds(frame(spark, noise(9, 64, scale=1e17))).collect()
    assert len(wide) == 9 and {r["inertia"] for r in wide} == {None}
