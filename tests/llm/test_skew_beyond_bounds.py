"""op4 and op8 where one passage, text or id has most rows and nothing may be broadcast."""

import pytest

from speechlake.llm import decontaminate, packing

PASSAGE = " ".join(f"p{k}" for k in range(14))


def sizes(frame):
    return sorted(frame.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


@pytest.fixture
def shuffled(monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)


def test_one_passage_in_most_documents(spark, shuffled):
    docs = spark.createDataFrame([(k, f"a{k} b c {PASSAGE if k % 10 else ''} d") for k in range(600)], "doc_id long, text string")
    items = spark.createDataFrame([(k, PASSAGE + (" tail" * (k % 3))) for k in range(9)], "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert {r.doc_id for r in got if r.contaminated} == {k for k in range(600) if k % 10} and {r.n_items for r in got if r.contaminated} == {9}
    kept = decontaminate.remove_contaminated(docs, items)
    assert {r.doc_id for r in kept.collect()} == {k for k in range(600) if not k % 10}


def test_copies_and_empty_texts_stay_spread(spark, shuffled):
    rows = [(k, None if k % 4 == 0 else "" if k % 4 == 1 else f"x {PASSAGE} y" if k % 4 == 2 else f"clean {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for what in ("documents", "spans"):
        kept = decontaminate.remove_contaminated(docs, items, what)
        assert kept.columns == docs.columns
        out = {r.doc_id: r.text for r in kept.collect()}
        if what == "documents":
            assert out == {k: t for k, t in rows if k % 4 != 2}
        else:
            assert out == {k: "x y" if k % 4 == 2 else t for k, t in rows}
    # what isn't hit is never dealt anew: the largest task holds about its share
    parts = sizes(decontaminate.remove_contaminated(docs, items))
    assert parts[-1] <= 3 * max(1, parts[-4])


def test_one_id_has_most_rows(spark):
    docs = spark.createDataFrame([(7 if k % 10 else k, "w " * (1 + k % 5), "s") for k in range(3000)], "doc_id long, text string, source string")
    out = packing.pack_documents(docs, capacity=16, per_source=16, group_docs=100).collect()
    assert sum(r.n_words for r in out) == sum(1 + k % 5 for k in range(3000))
    groups = {}
    for r in out:
        groups[r.pack_group] = groups.get(r.pack_group, 0) + 1
    assert max(groups.values()) <= 300 and len(groups) >= 25
