"""Embedding links: exact where an audit fails, the same from both sides, and defined for rows without an id."""

import numpy as np
import pytest

from speechlake.llm import embedding_dedup


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((700, 12))
    x[100:240] = x[100] + 0.1 * rng.standard_normal((140, 12))  # dense: more links than are kept as pairs
    x[240:400] = np.repeat(x[240:280], 4, axis=0) + 0.05 * rng.standard_normal((160, 12))
    x[400:460] = x[400]  # equal
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(near, label[None, :], 10**6).min(1))
        if (new == label).all():
            break
        label = new
    return x, near, label


def found(spark, x, **more):
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    return {r.vec_id: r for r in embedding_dedup.embedding_components(table, **more).collect()}


def test_a_failing_audit_still_finds_every_link(spark, crowd):
    x, near, label = crowd
    got = found(spark, x, recall=1.01)  # no audit reaches it
    assert [got[k].n_links for k in range(len(x))] == near.sum(1).tolist()
    assert [got[k].component_id for k in range(len(x))] == label.tolist()


def test_links_count_from_both_sides(spark, crowd):
    x, near, label = crowd
    got = found(spark, x)
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
    sparse = near.sum(1) <= embedding_dedup.DENSE
    assert links[sparse].sum() % 2 == 0 or near[sparse][:, ~sparse].any()


def test_pairs_found_by_one_side_count_for_both(spark):
    rows = [(0, 1, 2, 0, 3), (0, 2, 1, 1, 1), (0, 1, 2, 0, 3), (0, 5, 6, 1, 1), (0, 6, 5, 1, 2), (2, 9, 9, 0, 70), (0, 9, 8, 0, 1), (0, 9, 7, 1, 4), (1, 1, 2, 0, 0)]
    counts = embedding_dedup._counts(spark.createDataFrame(rows, "kind int, a long, b long, shard int, n long"))
    assert {r.counted: r.others for r in counts.collect()} == {1: 3, 2: 1, 5: 1, 6: 2, 9: 74}


def test_rows_without_an_id(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, -0.0]), (3, [1.0, 0.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)], key=str)
