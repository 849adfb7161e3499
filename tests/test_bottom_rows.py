"""Samples by group: the same rows as a full sort gives, and no sort of the whole table."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechlake.operators import mixing, ranking, selection


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 100 == 1, None).when(F.col("id") % 500 == 2, "rare").otherwise("a").alias("source"))


def sorted_way(rows, plan, seed):
    rn = F.row_number().over(Window.partitionBy("source").orderBy(ranking.seeded(seed, "source", "k"), "k"))
    planned = F.create_map(*[F.lit(x) for p in plan.items() for x in p])
    return sorted((r.k, r.rn) for r in rows.withColumn("rn", rn).where(F.col("rn") <= planned[F.col("source")]).collect())


@pytest.mark.parametrize("target", [0, 7, 300, 100_000])
def test_same_rows_as_a_full_sort(rows, target):
    ratios = {"a": 0.5, "b": 0.3, "rare": 0.2}
    got = mixing.ratio_mix(rows, "source", ratios, target, "k", 7)
    assert sorted((r.k, r.rn) for r in got.collect()) == sorted_way(rows, mixing.mix_plan(ratios, target), 7)


def test_only_the_first_buckets_are_sorted(rows, monkeypatch):
    seen = []
    real = ranking.group_row_numbers
    monkeypatch.setattr(ranking, "group_row_numbers", lambda df, *a, **b: (seen.append(df.count()), real(df, *a, **b))[1])
    mixing.ratio_mix(rows, "source", {"a": 0.5, "b": 0.5}, 40, "k").collect()
    assert 40 <= seen[0] < 60


def test_seeded_sample(rows):
    got = sorted(r.k for r in selection.seeded_sample(rows, 50, 3, "k").collect())
    assert got == sorted(r.k for r in rows.orderBy(ranking.seeded(3, "k"), "k").limit(50).collect())
    assert selection.seeded_sample(rows, 10**6, 3, "k").count() == 5000
    assert selection.seeded_sample(rows.limit(0), 5, 3, "k").collect() == []
