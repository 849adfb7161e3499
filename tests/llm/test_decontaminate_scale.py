"""Decontamination with many test windows: few false candidates, no task with most of them, small tables checked by their own size."""

import pytest
from pyspark.sql import functions as F

from speechlake.llm import decontaminate


def _hash_text(n, first, key):
    return F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(n))) for k in range(first)])


@pytest.fixture(scope="module")
def big(spark):
    """300,000 test windows; a third of the documents hold one and the same of them, some hold others."""
    items = spark.range(10_000).select(F.col("id").alias("item_id"), _hash_text(1_000_000, 39, "id").alias("text"))
    hot = items.where("item_id = 7").first().text
    docs = spark.range(0, 6000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(_hash_text(500, 20, "id"), F.lit(" " + hot))).otherwise(_hash_text(900_000, 60, "id")).alias("text"))
    return docs, items


def test_few_false_candidates_and_even_tasks(spark, big):
    docs, items = big
    tests = decontaminate.TestWindows(items)
    assert tests.n == 300_000 and not tests.small and tests.bits >= 32 * tests.n
    scanned = decontaminate.scan(docs, tests, ["doc_id"])
    passed = scanned.where("doc_id % 3 <> 0").agg(F.sum(F.size("_hits")).alias("p"), F.sum(F.col("n_words") - 9).alias("w")).first()
    assert passed.p <= 0.01 * passed.w
    found = decontaminate.contamination(docs, items).collect()
    assert len(found) == 6000 and all(r.contaminated == (r.doc_id % 3 == 0) for r in found)
    assert {r.n_hit for r in found if r.contaminated} == {39} and {r.n_items for r in found} == {0, 1}
    keys = scanned.where(F.size("_hits") > 0).select("_at", F.explode("_hits").alias("h"))
    salted = keys.withColumn("_salt", F.pmod(F.xxhash64("_at", "h.pos"), F.lit(decontaminate.SALTS)))
    largest = salted.groupBy("h.words", "_salt").count().agg(F.max("count")).first()[0]
    assert largest <= 2000 / decontaminate.SALTS * 1.5  # of 2,000 documents with the hot passage


@pytest.mark.parametrize("what", ["documents", "spans"])
def test_removal_moves_no_text(spark, big, what):
    docs, items = big
    few = items.where("item_id = 7")
    left = decontaminate.remove_contaminated(docs, few, what)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    if what == "documents":
        assert left.count() == 4000
    else:
        assert left.where("doc_id % 3 = 0").agg(F.max(F.size(F.split("text", " ")))).first()[0] == 20


def test_removal_beyond_the_broadcast_bound(spark, big, monkeypatch):
    docs, items = big
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    few = items.where("item_id = 7")
    assert decontaminate.remove_contaminated(docs, few).count() == 4000
    assert decontaminate.remove_contaminated(docs, few, "spans").where("doc_id % 3 = 0").agg(F.max(F.size(F.split("text", " ")))).first()[0] == 20
