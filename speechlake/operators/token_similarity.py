"""Similarity of two texts by matching their tokens: every token takes the other text's token that is nearest by cosine.

Recall is the mean, weighted by idf, of the best cosines of the reference's tokens, precision that of the hypothesis's, and
the score their harmonic mean. Vectors come from the caller: a table with a row a token, or a model that gives a list of
tokens' vectors. Rows are written once and dealt to blocks. A block counts its own references' tokens and is sent only what
it can't know: counts of tokens that other blocks have too, and the table's vectors. It asks a model for each of its
distinct tokens once. Rows of a block are compared together, texts too long for that in stripes.

Defined results: equal tokens have cosine 1, with or without a vector; a token without a vector, or with one that is zero
or not finite, is unlike all others; idf is ln((n + 1) / (texts that have the token + 1)) over the references, and a
token that none of them has has ln(n + 1); where all weights of a text are 0 its tokens count alike; two texts without
tokens are alike (1), one without is unlike any with (0); a null text has no tokens; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from speechlake.functions.text import tokens
from speechlake.session import ship_code, work_folder

#: Rows of a block at most (in proportion fewer where vectors have over 16 components), and bytes of its texts on average; comparisons of tokens that are held at once.
BLOCK_ROWS, BLOCK_BYTES, CELLS = 32768, 12 << 20, 1 << 17
#: With this setting Spark drops a query's shuffles at its end, here the join's behind the pairs, which are written by then.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What functions.text.tokens splits at, but for the plain blank.
_GAP = r"[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def split(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(the tokens of all texts, how many each has)."""
    plain = pc.fill_null(texts, "").cast(pa.large_string()).combine_chunks()
    if pc.any(pc.match_substring_regex(plain, _GAP)).as_py():
        plain = pc.replace_substring_regex(plain, _GAP, " ")
    parts = pc.split_pattern(plain, " ")
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    return flat.filter(real), np.diff(ends)


def coded(ref: pa.ChunkedArray, hyp: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, numbers of the references' tokens, how many each has, both for the hypotheses, references that have each distinct token)."""
    (r, n_r), (h, n_h) = split(ref), split(hyp)
    made = pa.concat_arrays([r, h]).dictionary_encode()
    codes, size = made.indices.to_numpy(), max(1, len(made.dictionary))
    own = np.sort(np.repeat(np.arange(len(n_r)), n_r) * size + codes[: len(r)])
    own = own[np.diff(own, prepend=-1) > 0]
    return made.dictionary, codes[: len(r)], n_r, codes[len(r) :], n_h, np.bincount(own % size, minlength=size)[: len(made.dictionary)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros where a row is zero or not finite."""
    v = np.where(np.isfinite(vectors).all(1, keepdims=True), vectors, 0.0)
    v /= np.maximum(np.abs(v).max(1, initial=0.0, keepdims=True), np.finfo(float).tiny)
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), np.finfo(float).tiny)


def mean(best: np.ndarray, w: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Of each row the mean of best by weight, all alike where weights are 0; real: 1 for a token, 0 for what fills the row."""
    w = w * real
    total = w.sum(1)
    return np.where(total > 0, (best * w).sum(1) / np.where(total > 0, total, 1.0), (best * real).sum(1) / real.sum(1))


def best_of(r: np.ndarray, h: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best cosine of every token of r (rows, tokens) and of h; rows of numbers. A row of more than CELLS comparisons comes alone."""
    recall, precision, step = [], np.full(h.shape, -np.inf), max(1, CELLS // (len(h) * h.shape[1]))
    other = vectors[h].transpose(0, 2, 1)
    for at in range(0, r.shape[1], step):
        part = r[:, at : at + step]
        near = vectors[part] @ other
        np.copyto(near, 1.0, where=part[:, :, None] == h[:, None, :])
        recall.append(near.max(2))
        np.maximum(precision, near.max(1), out=precision)
    return np.concatenate(recall, 1), precision


def match(r: np.ndarray, n_r: np.ndarray, h: np.ndarray, n_h: np.ndarray, vectors: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(precision, recall) of every row."""
    precision, recall = np.zeros(len(n_r)), np.zeros(len(n_r))
    recall[(n_r == 0) & (n_h == 0)] = precision[(n_r == 0) & (n_h == 0)] = 1.0
    at_r, at_h = np.cumsum(n_r) - n_r, np.cumsum(n_h) - n_h
    left = np.lexsort((n_h, n_r))
    left = left[(n_r[left] > 0) & (n_h[left] > 0)]
    # rows of as many reference tokens lie together, those of fewer hypothesis tokens first
    for same in np.split(left, np.flatnonzero(np.diff(n_r[left])) + 1):
        while len(same):
            long = n_r[same[0]]
            fits = np.arange(1, len(same) + 1) * long * n_h[same] <= CELLS
            take = max(1, int(fits.argmin()) if not fits.all() else len(same))
            rows, same = same[:take], same[take:]
            place = np.arange(n_h[rows[-1]])
            real = place < n_h[rows][:, None]
            a = r[at_r[rows][:, None] + np.arange(long)]
            b = h[at_h[rows][:, None] + np.where(real, place, 0)]
            best_r, best_h = best_of(a, b, vectors)
            recall[rows], precision[rows] = mean(best_r, idf[a], np.ones(a.shape)), mean(best_h, idf[b], real.astype(float))
    return precision, recall


def document_counts(refs: DataFrame, text: str = "ref") -> DataFrame:
    """(token, df): how many texts have it. refs: a row a text."""
    each = refs.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("df"))


def token_similarity(pairs: DataFrame, vectors: DataFrame | Callable[[list[str]], np.ndarray], refs: DataFrame | None = None) -> DataFrame:
    """pairs with precision, recall and f1. pairs: (ref, hyp, ...); vectors: (token, vector), a row a token, or a function from tokens to an array with a row for each; refs: (ref) of the texts that idf is over, those of pairs if not given."""
    spark = pairs.sparkSession
    ship_code(spark)
    path, own = work_folder(spark, "token_pairs"), refs is None
    was = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        pairs.select(F.struct(*pairs.columns).alias("row"), F.monotonically_increasing_id().alias("at")).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANED, was)
    written = spark.read.schema(StructType([StructField("row", pairs.schema)]).add("at", "long")).parquet(path)
    held = written.agg(F.count("*").alias("rows"), *(F.sum(F.octet_length(f"row.{c}")).alias(c) for c in ("ref", "hyp"))).first()
    n = held.rows if own else refs.count()
    if isinstance(vectors, DataFrame):
        table = vectors.groupBy("token").agg(F.max(F.col("vector").cast("array<double>")).alias("vector"))
        dim = table.select(F.max(F.size("vector")).alias("n")).first().n or 1
    else:
        dim = np.shape(vectors(["a"]))[1]
    block = max(1, min(BLOCK_ROWS * 16 // max(16, dim), BLOCK_BYTES * held.rows // max(1, (held.ref or 0) + (held.hyp or 0))))
    rows = written.select(F.floor(F.col("at") / block).alias("block"), "row")

    def count(of: pa.Table) -> pa.Table:
        row = of.column("row").combine_chunks()
        names, _, _, _, _, here = coded(pa.chunked_array([row.field("ref")]), pa.chunked_array([row.field("hyp")]))
        return pa.table({"place": pa.array(np.full(len(names), of.column("block")[0].as_py()), pa.int64()), "token": names.cast(pa.string()), "here": pa.array(here if own else 0 * here, pa.int64())})

    has = rows.groupBy("block").applyInArrow(count, "place long, token string, here long")
    if own:
        has = has.withColumn("df", F.sum("here").over(Window.partitionBy("token")))
    else:
        has = has.join(document_counts(refs), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    if isinstance(vectors, DataFrame):
        has = has.join(table, "token", "left")
        sent = has.where("df != here OR vector IS NOT NULL").select("place", "token", "df", "vector")
    else:
        sent = has.where("df != here").select("place", "token", "df")
    model = None if isinstance(vectors, DataFrame) else vectors

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.column("row").combine_chunks()
        names, r, n_r, h, n_h, here = coded(pa.chunked_array([row.field("ref")]), pa.chunked_array([row.field("hyp")]))
        df, at = here if own else 0 * here, pc.index_in(right.column("token").cast(names.type), value_set=names).to_numpy().astype(int)
        df[at] = right.column("df").to_numpy()
        if model is None:
            v, given = np.zeros((len(names), dim)), right.column("vector").combine_chunks()
            fits = pc.fill_null(pc.equal(pc.list_value_length(given), dim), False)
            v[at[fits.to_numpy(zero_copy_only=False)]] = given.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        else:
            v = np.asarray(model(names.to_pylist()), float).reshape(len(names), dim) if len(names) else np.zeros((0, dim))
        precision, recall = match(r, n_r, h, n_h, unit(v), np.log((n + 1) / (df + 1)))
        both = precision + recall
        f1 = np.where(both > 0, 2 * precision * recall / np.where(both > 0, both, 1.0), 0.0)
        return pa.table({"row": left.column("row"), "precision": precision, "recall": recall, "f1": f1})

    out = StructType([written.schema["row"], *(StructField(c, DoubleType()) for c in ("precision", "recall", "f1"))])
    scored = rows.groupBy("block").cogroup(sent.groupBy("place")).applyInArrow(score, out)
    return scored.select("row.*", "precision", "recall", "f1")
