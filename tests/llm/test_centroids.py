"""Clusters against plain integer arithmetic: random and adversarial vectors, ties, huge magnitudes, odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from speechlake.llm import centroids as C


def plain(rows, dim, k, rounds, scale=1024, seed="3"):
    """(vec_id, cluster, distance) of each row in order, and the centroids."""
    kept = [(i, [math.floor(scale * v) if abs(v) < 1e300 else int(v) * scale for v in map(float, e)]) for i, e in rows if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    cents = [list(e) for _, e in order[:k]]

    def assign():
        out = []
        for i, e in kept:
            d = [sum((a - b) ** 2 for a, b in zip(e, c, strict=True)) for c in cents]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds if cents else 0):
        found = assign()
        for c in range(len(cents)):
            own = [e for (_, e), (_, at, _) in zip(kept, found, strict=True) if at == c]
            if own:
                cents[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign() if cents else [], cents


def same(spark, rows, dim, k=8, rounds=10):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, cents = C.cluster_vectors(table, dim, k, rounds)
    want, want_cents = plain(rows, dim, k, rounds)
    assert cents == want_cents
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance) for r in got.collect()))) == sorted(str((i, c, d if d < 1 << 63 else None)) for i, c, d in want)


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    same(spark, [(k, rng.standard_normal(6).tolist()) for k in range(300)], 6)


def test_ties_and_copies(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for k in range(200)]
    same(spark, rows + [(k, [0.0, 0.0, 0.0]) for k in range(200, 300)], 3)


def test_huge_tiny_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) * 10.0 ** rng.choice([-300, 0, 3, 5, 12, 30]) for _ in range(4)]) for k in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [math.nan] * 4), (104, [math.inf, 0.0, 0.0, 0.0]), (105, [1.0] * 5), (None, [0.5] * 4), (7, [0.25] * 4), (106, [1e308, -1e308, 0.0, 0.0])]
    same(spark, rows, 4, k=5, rounds=4)


def test_few_and_no_vectors(spark):
    same(spark, [(1, [1.0, 2.0]), (2, [5.0, 2.0])], 2)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    rows, cents = C.cluster_vectors(empty)
    assert rows.collect() == [] and cents == []


@pytest.mark.parametrize("size", [10, 2000, 1 << 26])
def test_intervals_hold_the_exact_values(size):
    rng = np.random.default_rng(size)
    v = rng.integers(-size, size + 1, (400, 64))
    near = C.Centroids(rng.integers(-size, size + 1, (8, 64)).tolist() + v[:4].tolist())
    low, high = near.intervals(v)
    exact = (near.ints * near.ints).sum(1)[None, :] - 2 * v @ near.ints.T
    assert (low <= exact).all() and (exact <= high).all()


def test_only_overlaps_are_compared_exactly():
    rng = np.random.default_rng(5)
    v = rng.integers(-1000, 1001, (2000, 64))
    near = C.Centroids(rng.integers(-1000, 1001, (8, 64)).tolist())
    best, distance, exact = near.nearest(v)
    d = ((v[:, None, :] - near.ints[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (distance == d.min(1)).all() and exact < 20


def test_limbs():
    for x in (0, -1, 5, 2**31, -(2**31), -(2**31) - 1, 2**63, -(10**40), 10**60):
        assert sum(v << (32 * k) for k, v in enumerate(C.limbs(x))) == x


def test_extra_columns_and_inertia(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(k, rng.standard_normal(64).tolist(), 1, "x") for k in range(50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, small string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = C.op13_centroid_clusters(spark, str(tmp_path)).collect()
    assert len(got) == 50 and {r.inertia for r in got} == {sum(r.distance for r in got)}
    assert all(r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster) for r in got)
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert C.op13_centroid_clusters(spark, f"{tmp_path}/none").collect() == []
