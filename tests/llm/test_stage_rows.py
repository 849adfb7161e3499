"""Stages over tables whose rows lack or repeat a doc_id, and the ways of joining what is too many to broadcast."""

import random

from speechlake.llm import common, ngram_join
from speechlake.llm.exact_substring import remove_repeats

WORDS = [f"word{k}" for k in range(400)]


def text(seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _gone int, _cut string").repartition(3)


def row(i, t):
    return (i, t, "s", len(t) if t is not None else None, 1, "x")


def test_every_row_is_judged(spark):
    a, b, c, d = (text(k) for k in range(4))
    rows = [row(1, a), row(1, a), row(1, b), row(2, a + " more"), row(None, c), row(None, c), row(None, b), row(3, d), row(4, None), row(5, "")]
    kept = ngram_join.keep_one_of_each(table(spark, rows))
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == ["doc_id", "text", "source", "n_chars", "_gone", "_cut"]
    assert found == sorted([(1, a), (1, b), (None, c), (3, d), (4, None), (5, "")], key=str)


def test_texts_that_share_an_id_are_cut_apart(spark):
    long, other = text(7, 80), text(8, 80)
    first, second = sorted([long + " " + other, text(9, 80)])
    rows = [row(1, first), row(1, second), row(2, long + " tail"), row(None, other), row(3, "short"), row(4, None)]
    found = {(r.doc_id, r.text, r.n_chars) for r in remove_repeats(table(spark, rows)).collect()}
    assert {t for i, t, _ in found if i == 1} == {first, second}
    assert (3, "short", 5) in found and (4, None, None) in found
    assert not any(i is None for i, _, _ in found)  # wholly repeated
    left = next(t for i, t, _ in found if i == 2)
    assert left == "tail" and (2, left, len(left)) in found


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [row(k, text(100 + k % 7, 50) + " " + text(500 + k, 2 + k % 4)) for k in range(60)] + [row(60 + k, None) for k in range(5)]
    docs = table(spark, rows)
    want = sorted(ngram_join.shingle_components(docs).collect())
    kept, cut = sorted(r.doc_id for r in ngram_join.keep_one_of_each(docs).collect()), sorted((r.doc_id, r.text) for r in remove_repeats(docs.where("doc_id < 60")).collect())
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", -1)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 3)
    assert sorted(ngram_join.shingle_components(docs).collect()) == want
    assert sorted(r.doc_id for r in ngram_join.keep_one_of_each(docs).collect()) == kept
    assert sorted((r.doc_id, r.text) for r in remove_repeats(docs.where("doc_id < 60")).collect()) == cut


def test_frequent_classes_and_rows_without_one(spark):
    classes = spark.createDataFrame([(1, 1, 9000, "a"), (2, 1, 3, "b"), (2, 2, 1, "c")], "k long, l long, copies long, v string")
    rows = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 2, 2), (3, None, 1), (4, 7, 7), (5, 1, 1)], "id long, k long, l long")
    import pyspark.sql.functions as F

    got = {r.id: r.v for r in common.join_classes(rows, classes, ["k", "l"], ["v"], F.xxhash64("id")).collect()}
    assert got == {0: "a", 1: "b", 2: "c", 3: None, 4: None, 5: "a"}
