"""Text functions on hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from speechlake.functions import text


def values(spark, rows, expr):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{n} {t}" for n, t in enumerate(_types(rows[0]))))
    return [r[0] for r in df.orderBy("k").select(expr).collect()]


def _types(row):
    return ["double" if isinstance(x, float) else "string" for x in row]


def test_normalizers(spark):
    rows = [("Привет, «Мир»!",), ("Ёж — ест  $5",), (None,)]
    assert values(spark, rows, text.normalize_basic(F.col("c0"))) == ["привет «мир»", "ёж — ест  5", None]
    assert values(spark, rows, text.normalize_advanced(F.col("c0"))) == ["привет мир", "еж ест $5", ""]


def test_tokens(spark):
    assert values(spark, [("  a b\t c\n",), ("",), (None,)], text.tokens(F.col("c0"))) == [["a", "b", "c"], [], []]


def test_categories(spark):
    rows = [(x,) for x in ("12", "+7", "3,5", "США", "NASA.", "nasa", "covid19", "дом", "", None)]
    assert values(spark, rows, text.token_category(F.col("c0"))) == ["number"] * 3 + ["abbr"] * 2 + ["latin"] * 2 + ["word"] * 3


def test_classes(spark):
    rows = [(0.5, 0.6), (0.5, 0.7), (0.15, 0.1), (0.1, 0.1)]
    assert values(spark, rows, text.classify_utterance(F.col("c0"), F.col("c1"))) == ["full_misunderstanding", "partial", "partial", "local"]
    no_sim = F.lit(None).cast("double")
    assert values(spark, rows, text.classify_utterance(F.col("c0"), no_sim)) == ["full_misunderstanding", "full_misunderstanding", "partial", "local"]


def test_capitalized(spark):
    assert values(spark, [("Иван и США в Москве",), ("",)], F.size(text.capitalized_tokens(F.col("c0")))) == [2, 0]


@pytest.mark.parametrize(("path", "stem", "suffix"), [("a/b.wav", "b", ".wav"), ("b\\c.tar.gz", "c.tar", ".gz"), ("x", "x", ""), ("d/.hidden", ".hidden", "")])
def test_file_names(spark, path, stem, suffix):
    row = spark.range(1).select(text.file_stem(F.lit(path)), text.file_suffix(F.lit(path))).head()
    assert tuple(row) == (stem, suffix)


def test_separators_of_ascii_are_gaps(spark):
    from pyspark.sql import functions as F

    from speechlake.functions import text

    x = "\x1ca\x1d \x1eb\x1fc\x85d\u00a0e\u2003 f "
    r = spark.createDataFrame([(x,)], "x string").select(text.tokens(F.col("x")).alias("t"), text.normalize_advanced(F.col("x")).alias("n")).head()
    assert r.t == x.split()
    import re

    assert r.n == re.sub(r"\s\s+", " ", x).strip()
