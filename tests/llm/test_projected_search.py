"""Projected search against brute force: random, clustered and repeated vectors, unlike lengths, odd rows, many shards and parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.llm import projected_search as P


def exact(rows, k, every):
    """{(query's place): [(score, vec_id), ...]} by brute force, summed from the first component on."""
    good = [(n, i, np.array(e, float)) for n, (i, e) in enumerate(rows) if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    out = {}
    for n, i, e in good:
        if i % every == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                near = [(float(np.add.accumulate(e * f)[-1]), j) for m, j, f in good if m != n and len(f) == len(e)]
            out[n] = (i, sorted((x for x in near if x[0] == x[0]), key=lambda x: (-x[0], x[1]))[:k])
    return out


def found(spark, rows, k=5, every=5, kind="array<double>", **more):
    table = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(3)
    got = {}
    for r in P.nearest_by_inner_product(table, F.col("vec_id") % every == 0, k, **more).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {i: [x[1:] for x in sorted(v)] for i, v in got.items()}


def test_chi_square_quantiles():
    for p, d, x in ((0.95, 2, 5.991), (0.99, 16, 32.0), (0.5, 10, 9.342), (0.9, 8, 13.362)):
        assert abs(P.chi_square_quantile(p, d) - x) < 2e-3


def test_a_sure_search_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.standard_normal(10) * 10.0 ** rng.integers(-2, 3)).tolist()) for k in range(400)]
    got = found(spark, rows, confidence=1 - 1e-13)
    want = exact(rows, 5, 5)
    assert got == {i: v for i, v in want.values()}


@pytest.mark.parametrize("tasks", [1, 40])
def test_recall_on_clusters(spark, monkeypatch, tasks):
    monkeypatch.setattr(P, "n_buckets", lambda _: tasks)
    monkeypatch.setattr(P, "LEAST_ROWS", 200)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((40, 32))
    x = centre[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got, want = found(spark, rows, k=20, every=50), exact(rows, 20, 50)
    hits = sum(len(set(got[i]) & set(v)) for i, v in want.values())
    assert hits >= 0.95 * sum(len(v) for _, v in want.values())
    assert all(len(got[i]) == 20 for i, _ in want.values())


def test_the_search_stops_early():
    rng = np.random.default_rng(3)
    centre = 5 * rng.standard_normal((60, 24))
    x = centre[rng.integers(0, 60, 20_000)] + 0.1 * rng.standard_normal((20_000, 24))
    held = P.Asked(x[:50], 21, P.PROJECTED, P.SEED, P.chi_square_quantile(P.CONFIDENCE, P.PROJECTED))
    held.meet(P.load(P.build(np.arange(20_000), x, P.PROJECTED, P.SEED, 20), P.PROJECTED))
    assert held.verified < 0.25 * 50 * 20_000
    scores = x[:50] @ x.T
    hit = sum((held.best[n][0] >= np.sort(scores[n])[-21] - 1e-9).sum() for n in range(50))
    assert hit >= 0.97 * 50 * 21


def test_copies_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [1.0, 2.0, 0.0]) for k in range(200)]  # a third of all rows are copies
    rows += [(k, rng.integers(-1, 2, 3).astype(float).tolist()) for k in range(200, 600)]
    rows += [(605, [1.0, 2.0, 0.0]), (605, [1.0, 2.0, 0.0]), (610, [0.0, 0.5, 1.0]), (610, [3.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted((r.query_id, r["rank"], r.score, r.vec_id) for r in P.nearest_by_inner_product(table, F.col("vec_id") % 5 == 0, 7, confidence=1 - 1e-13).collect())
    want = sorted((i, n + 1, s, j) for i, v in exact(rows, 7, 5).values() for n, (s, j) in enumerate(v))
    assert got == want


def test_odd_vectors(spark):
    rows = [(0, None), (5, []), (10, [0.0, 0.0]), (15, [1.0, None]), (20, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (None, [1.0, 1.0]), (30, [1.0, 2.0]), (31, [2.0, 1.0]), (35, [1.0, 1.0, 1.0]), (40, [-0.0, 3.0])]
    assert found(spark, rows) == {i: v for i, v in exact(rows, 5, 5).values() if v}
    huge = [(0, [1e200, 1e200]), (5, [1e200, -1e200]), (10, [1e-200, 0.0]), (15, [1.0, 1.0]), (20, [1e308, 1e308]), (21, [2.0, 0.5])]
    assert found(spark, huge) == {i: v for i, v in exact(huge, 5, 5).values() if v}
    assert found(spark, []) == {}


def test_fewer_candidates_than_asked(spark):
    assert found(spark, [(5, [1.0, 0.0]), (6, [0.5, 0.5])], k=20) == {5: [(0.5, 6)]}
