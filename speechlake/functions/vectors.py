"""Vector functions as Catalyst expressions, and hooks for pluggable encoders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine with eps added to the denominator."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(eps))


def guarded_cosine(xs: list[Column], ys: list[Column]) -> Column:
    """Cosine of two short vectors of columns; 1 where either is zero."""
    pairs = list(zip(xs, ys, strict=True))
    d = sum((x * y for x, y in pairs), F.lit(0.0))
    n = F.sqrt(sum((x * x for x in xs), F.lit(0.0))) * F.sqrt(sum((y * y for y in ys), F.lit(0.0)))
    return F.when(n == 0, F.lit(1.0)).otherwise(d / n)


def digests(texts: list[str]) -> np.ndarray:
    """A stand-in for a model's vectors: the sixteen bytes of each text's MD5, less their middle."""
    return np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in texts), np.uint8).reshape(-1, 16) - 127.5


def text_similarity(df: DataFrame, left: str, right: str, encoder: Callable[[pd.Series], pd.Series] | None, name: str = "sim") -> DataFrame:
    """df with the cosine of the encoded texts of two columns; every distinct text is encoded once. Without an encoder the column is null."""
    if encoder is None:
        return df.withColumn(name, F.lit(None).cast("double"))

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield encoder(batch)

    texts = df.select(F.col(left).alias("_t")).union(df.select(F.col(right).alias("_t"))).where("_t is not null").distinct().withColumn("_v", encode("_t"))
    a, b = texts.select(F.col("_t").alias("_lt"), F.col("_v").alias("_lv")), texts.select(F.col("_t").alias("_rt"), F.col("_v").alias("_rv"))
    joined = df.join(a, df[left] == F.col("_lt"), "left").join(b, df[right] == F.col("_rt"), "left")
    return joined.withColumn(name, cosine(F.col("_lv"), F.col("_rv"))).drop("_lt", "_lv", "_rt", "_rv")


def pair_scores(df: DataFrame, left: str, right: str, scorer: Callable[[list[str], list[str]], list[float | None]] | None, name: str = "bert_score", size: int = 64) -> DataFrame:
    """df with the score that the plugged model gives two texts (a token-matching F1, say), in batches; null without a model, and for a batch that it refuses."""
    if scorer is None:
        return df.withColumn(name, F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list[float | None] = []
        for at in range(0, len(a), size):
            x, y = a.iloc[at : at + size].fillna("").tolist(), b.iloc[at : at + size].fillna("").tolist()
            try:
                out += scorer(x, y)
            except Exception:  # noqa: BLE001  a model's own errors
                out += [None] * len(x)
        return pd.Series(out, dtype="float64")

    scored = run(F.col(left), F.col(right))
    return df.withColumn("_score", scored).withColumn(name, F.when(~F.isnan("_score"), F.col("_score"))).drop("_score")
