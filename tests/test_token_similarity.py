"""Token matching against a plain double loop; odd vectors and texts; blocks change nothing."""

import math
import random
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechlake.functions.text import tokens
from speechlake.functions.vectors import digests
from speechlake.operators import token_similarity as T


def plain(pairs, vectors):
    n, df = len(pairs), {}
    for r, _ in pairs:
        for t in set((r or "").split()):
            df[t] = df.get(t, 0) + 1
    idf = lambda t: math.log((n + 1) / (df.get(t, 0) + 1))

    def cos(a, b):
        if a == b:
            return 1.0
        x, y = vectors.get(a), vectors.get(b)
        if not x or not y or not any(x) or not any(y) or not all(map(math.isfinite, x + y)):
            return 0.0
        return sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))

    out = []
    for r, h in pairs:
        r, h = (r or "").split(), (h or "").split()
        if not r or not h:
            out.append((float(len(r) == len(h)),) * 3)
            continue
        mean = lambda a, b: (lambda best, w: sum(x * y for x, y in zip(best, w)) / sum(w) if sum(w) > 0 else sum(best) / len(best))([max(cos(x, y) for y in b) for x in a], [idf(x) for x in a])
        p, q = mean(h, r), mean(r, h)
        out.append((p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0))
    return out


@pytest.mark.parametrize("rows", [4096, 7])
def test_against_the_definition(spark, monkeypatch, rows):
    monkeypatch.setattr(T, "BLOCK_ROWS", rows)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(25)]
    vectors = {w: [rng.gauss(0, 1) for _ in range(5)] for w in words[:20]} | {"w20": [0.0] * 5, "w21": [math.nan] * 5}
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(8))), " ".join(rng.choices(words, k=rng.randrange(8)))) for _ in range(60)] + [(None, None), ("", "w1"), ("w2", None), ("w1 w1", "w1"), ("w1 w1", "w1")]
    frame = spark.createDataFrame([(k, r, h) for k, (r, h) in enumerate(pairs)], "k long, ref string, hyp string").repartition(3)
    found = {r.k: (r.precision, r.recall, r.f1) for r in T.token_similarity(frame, spark.createDataFrame(list(vectors.items()), "token string, vector array<double>")).collect()}
    assert len(found) == len(pairs)
    for k, want in enumerate(plain(pairs, vectors)):
        assert found[k] == pytest.approx(want, abs=1e-9), pairs[k]


def test_no_rows_and_no_vectors(spark):
    none = spark.createDataFrame([], "token string, vector array<double>")
    assert T.token_similarity(spark.createDataFrame([], "ref string, hyp string"), none).collect() == []
    (r,) = T.token_similarity(spark.createDataFrame([("a b", "a c")], "ref string, hyp string"), none).collect()
    # one text: "a" and "b" weigh ln(2 / 2) = 0 and count alike in the reference; "c" weighs ln 2 and "a" nothing in the hypothesis
    assert (r.precision, r.recall, r.f1) == (0.0, 0.5, 0.0)


def test_a_model_in_place_of_a_table(spark, monkeypatch):
    # blocks of few rows: counts of other blocks' tokens have to come in; stripes: a text of more comparisons than are held at once
    monkeypatch.setattr(T, "BLOCK_ROWS", 5)
    monkeypatch.setattr(T, "CELLS", 16)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(9))), " ".join(rng.choices(words, k=rng.randrange(9)))) for _ in range(40)] + [(" ".join(rng.choices(words, k=50)), " ".join(rng.choices(words, k=60))), (None, "w1")]
    frame = spark.createDataFrame([(k, r, h, [{"a": k}]) for k, (r, h) in enumerate(pairs)], "k long, ref string, hyp string, more array<map<string, long>>").repartition(3)
    vectors = dict(zip(words, digests(words).tolist(), strict=True))
    found = {r.k: r for r in T.token_similarity(frame, digests).collect()}
    assert len(found) == len(pairs)
    for k, want in enumerate(plain(pairs, vectors)):
        assert (found[k].precision, found[k].recall, found[k].f1) == pytest.approx(want, abs=1e-9), pairs[k]
        assert found[k].ref == pairs[k][0] and found[k].more == [{"a": k}]


def test_references_of_their_own(spark):
    refs, vectors = spark.createDataFrame([("a b",), ("a",), ("a c",)], "ref string"), {"a": [1.0, 0.0], "b": [1.0, 1.0], "d": [0.0, 1.0]}
    table = spark.createDataFrame(list(vectors.items()), "token string, vector array<double>")
    (r,) = T.token_similarity(spark.createDataFrame([("a b", "b d")], "ref string, hyp string"), table, refs).collect()
    a, b, d, half = math.log(4 / 4), math.log(4 / 2), math.log(4), math.sqrt(0.5)
    assert (r.precision, r.recall) == pytest.approx(((b + d * half) / (b + d), (a * half + b) / (a + b)))


def test_tokens_are_those_of_the_engine(spark):
    texts = ["".join(map(chr, (97, c, 98))) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["", "  ", " a\t\u3000b ", None]
    want = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, x string").select("k", tokens(F.col("x")).alias("t")).orderBy("k").collect()]
    flat, n = T.split(pa.chunked_array([pa.array(texts, pa.string())]))
    flat, ends = flat.to_pylist(), n.cumsum()
    assert [flat[b - k : b] for k, b in zip(n, ends, strict=True)] == want


def test_the_pairs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    frame = spark.range(20).selectExpr("concat('a b', id) AS ref", "'a b' AS hyp").mapInPandas(seen, "ref string, hyp string")
    assert T.token_similarity(frame, digests).count() == 20
    assert made.value == 20


def test_the_shuffles_behind_the_pairs_are_dropped(spark):
    was = spark.conf.get(T.CLEANED, "false")
    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: {p.name.split("_")[1] for p in folder.rglob("shuffle_*.data")}
    before, frame = held(), spark.range(100).selectExpr("'a b' AS ref", "concat('a ', id) AS hyp").repartition(3, "hyp")
    T.token_similarity(frame, digests)
    # of the two shuffles that have run, that of the pairs and that of the count over what was written, the first goes
    stop = time.time() + 20
    while len(held() - before) > 1 and time.time() < stop:
        time.sleep(0.2)
    assert len(held() - before) <= 1
    assert spark.conf.get(T.CLEANED, "false") == was
