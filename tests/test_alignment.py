"""Alignment: golden rows, properties, and a backtrace written from the tie rule alone."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechlake.functions import alignment
from speechlake.operators import errors

GOLDEN = [
    ("a b c d", "a x c d e", [("correct", "a", "a"), ("sub", "b", "x"), ("correct", "c", "c"), ("correct", "d", "d"), ("ins", None, "e")], 0.5, 0.428571),
    ("a b", "b", [("del", "a", None), ("correct", "b", "b")], 0.5, 0.666667),
    ("a b", "c", [("del", "a", None), ("sub", "b", "c")], 1.0, 1.0),
    ("a", "b a c", [("ins", None, "b"), ("correct", "a", "a"), ("ins", None, "c")], 2.0, 4.0),
    ("", "x", [("ins", None, "x")], 1.0, 1.0),
    ("x y", "", [("del", "x", None), ("del", "y", None)], 1.0, 1.0),
    ("a b c", "b c d", [("del", "a", None), ("correct", "b", "b"), ("correct", "c", "c"), ("ins", None, "d")], 0.666667, 0.6),
]


def plain(r, h):
    cost = [[i + j if not i or not j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (r[i - 1] != h[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(r), len(h), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (r[i - 1] != h[j - 1]):
            i, j = i - 1, j - 1
            out.append(("correct" if r[i] == h[j] else "sub", r[i], h[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("del", r[i], None))
        else:
            j -= 1
            out.append(("ins", None, h[j]))
    return out[::-1]


def lists(x):
    return pa.array(x, pa.list_(pa.string()))


def test_golden(spark):
    pairs = spark.createDataFrame([(k, "m", r, h) for k, (r, h, *_) in enumerate(GOLDEN)], "utt_id int, model_id string, ref string, hyp string")
    scores = {r.utt_id: r for r in errors.per_utterance(pairs, with_ops=True).collect()}
    plain_scores = {r.utt_id: r for r in errors.per_utterance(pairs).collect()}
    ops = alignment.align_ops(lists([g[0].split() for g in GOLDEN]), lists([g[1].split() for g in GOLDEN])).to_pylist()
    for k, (_, _, want, wer, cer) in enumerate(GOLDEN):
        assert [(o["op"], o["ref"], o["hyp"]) for o in ops[k]] == want
        for s in (scores[k], plain_scores[k]):
            assert (s.wer, s.cer, s.ser) == (wer, cer, 1.0)
            assert (s.ops_sub, s.ops_ins, s.ops_del, s.ops_correct) == tuple(sum(o[0] == x for o in want) for x in ("sub", "ins", "del", "correct"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14)), min_size=1, max_size=12))
def test_against_plain(rows):
    ref, hyp = lists([r for r, _ in rows]), lists([h for _, h in rows])
    counts, ops = alignment.count_edits(ref, hyp).to_pylist(), alignment.align_ops(ref, hyp).to_pylist()
    for (r, h), c, o in zip(rows, counts, ops, strict=True):
        want = plain(r, h)
        assert [(x["op"], x["ref"], x["hyp"]) for x in o] == want
        for name in ("sub", "ins", "del", "correct"):
            assert c[name] == sum(w[0] == name for w in want)
        assert c["ins"] - c["del"] == len(h) - len(r) and c["correct"] + c["sub"] + c["del"] == len(r)


def test_null_and_sliced_lists():
    ref, hyp = lists([["z"], None, ["a", "b"], []]).slice(1), lists([["z"], ["a"], ["b"], None]).slice(1)
    assert [(c["sub"], c["ins"], c["del"]) for c in alignment.count_edits(ref, hyp).to_pylist()] == [(0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_native_distance_agrees(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice("abcde") for _ in range(rng.randrange(12))], [rng.choice("abcde") for _ in range(rng.randrange(12))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, r array<string>, h array<string>")
    c = alignment.edit_counts(F.col("r"), F.col("h"))
    for row in df.select(alignment.native_distance(F.col("r"), F.col("h")).alias("n"), c.alias("c")).collect():
        assert row.n == row.c["sub"] + row.c["ins"] + row.c["del"]


def test_filters_run_before_the_kernel(spark, capsys):
    from speechlake.operators.manifests import quality_filter

    m = spark.createDataFrame([("a", "x y", 2.0)], "audio_filepath string, text string, duration double")
    p = spark.createDataFrame([("a", "x z")], "audio_filepath string, pred_text string")
    quality_filter(m, p, 1.0).explain()
    plan = capsys.readouterr().out
    assert plan.index("ArrowEvalPython") < plan.index("Join") < re.search(r"duration#\d+ >= 1", plan).start()  # children are printed below


@pytest.mark.parametrize("size", [1, 2000])
def test_long_rows(size):
    r = [str(k % 7) for k in range(size)]
    (c,) = alignment.count_edits(lists([r]), lists([r[1:] + ["q"]])).to_pylist()
    assert c["sub"] + c["ins"] + c["del"] <= 2


@pytest.mark.parametrize("wide", [1024, 100, 10])
def test_rows_of_every_width_together(wide, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "_ROWS", 37)
    rng, pairs = random.Random(wide), []
    for k in range(300):
        names = [f"w{x}" for x in range(rng.choice([2, 5, 50]))]
        r = [rng.choice(names) for _ in range(rng.choice([0, 1, 63, 64, 65, 128, 130]) if k % 3 == 0 else rng.randrange(30))]
        h = [x for x in r if rng.random() > 0.1] + [rng.choice(names) for _ in range(rng.randrange(4))]
        pairs.append((r, h if k % 10 else []))
    ref, hyp = lists([r for r, _ in pairs]), lists([h for _, h in pairs])
    ops, counts = alignment.align_ops(ref, hyp).to_pylist(), alignment.count_edits(ref, hyp).to_pylist()
    texts = [["".join(x[-1] for x in side) + "жé" * (len(side) % 2) for side in p] for p in pairs]
    chars = alignment.count_chars(pa.array([r for r, _ in texts] + [None]), pa.array([h for _, h in texts] + ["x"])).to_pylist()
    for (r, h), o, c, (s, t), n in zip(pairs, ops, counts, texts, chars, strict=False):
        want = plain(r, h)
        assert [(x["op"], x["ref"], x["hyp"]) for x in o] == want
        assert [c[k] for k in ("sub", "ins", "del", "correct")] == [sum(w[0] == k for w in want) for k in ("sub", "ins", "del", "correct")]
        assert n == sum(w[0] != "correct" for w in plain(list(s), list(t)))
    assert chars[-1] is None


def test_native_distance_names_its_words_once(spark, capsys):
    """Words are made once a row: their expression stands once in the plan, and rows keep their distances at every size of the book of words."""
    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(n)), " ".join(f"w{k}" for k in range(0, n, 2)) + " x") for n in (1, 30, 3000, 19_998, 20_001)] + [("a b", "a b"), ("", ""), (None, "a")], "a string, b string")
    found = df.select(alignment.native_distance(F.split("a", " "), F.split("b", " ")).alias("d"))
    found.explain()
    assert capsys.readouterr().out.count("split(a") == 1
    assert [r.d for r in found.collect()] == [1, 15, 1500, 9999, None, 0, 0, None]
