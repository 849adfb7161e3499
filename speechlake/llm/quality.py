"""Quality by compression: zstandard dictionaries of good and bad text, and a calibrated size difference.

Every whole text is cut into blocks (so that long texts don't compress by themselves), each block is
compressed under both dictionaries, and the normalised difference of the sizes, with how far the text shrinks,
goes through a logistic curve. Dictionaries come from one half of a bounded labelled sample, the curve from the other half.

Defined results: null and empty texts score as the curve where all sizes are 0; repeated rows and ties get the same
score each; rows without a doc_id are scored and never held out or learned from; every label of an id with several
counts in training; an empty table gives no rows; no usable labels of either class: every score is 0.5; extra columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from speechlake.llm.common import lean, text_chunks, tune

#: Bounds of the labelled sample: documents of each class, characters of one document.
TRAIN_DOCS, TRAIN_CHARS = 3000, 16_384
#: Bytes of a block, of a dictionary, and zstandard's level.
BLOCK, DICT_BYTES, LEVEL = 2048, 65_536, 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]

    def score(self, x: np.ndarray) -> np.ndarray:
        a = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)
        return 1 / (1 + np.exp(-np.clip(a @ self.weights, -60, 60)))


def evidence(text: bytes, good, bad) -> tuple[float, ...]:
    """What the curve is drawn over, all from sizes under both dictionaries.

    The normalised difference (bad - good) / (bad + good) of the whole text and of its worst block; how far the
    text and its most repetitive block shrink under the good dictionary; the logarithm of the size.
    """
    if not text:
        return (0.0,) * 5
    g = b = 0
    worst, least = 1.0, 0.0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        x, y = len(good.compress(block)), len(bad.compress(block))
        g, b = g + x, b + y
        if at == 0 or len(block) >= BLOCK // 4:
            worst, least = min(worst, (y - x) / (y + x)), min(least, math.log((x + 16) / (len(block) + 16)))
    return (b - g) / (b + g), worst, math.log((g + 16) / (len(text) + 16)), least, math.log(len(text))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on x by Newton steps, lightly held to zero."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, hold = np.zeros(a.shape[1]), np.full(a.shape[1], 1e-2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(hold), a.T @ (p - y) + hold * w)
    return w


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> QualityModel | None:
    """docs: (doc_id, text); labels: (doc_id, quality).

    The sample: of each class the train_docs labels that come first in an order of hashes, and of their texts those
    of at most TRAIN_CHARS characters. Only these few ids are broadcast; no text is shuffled.
    """
    drawn = [labels.where(F.col("quality") == k).select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(train_docs) for k in (0, 1)]
    few = drawn[0].unionByName(drawn[1])
    rows = docs.where((F.length("text") <= TRAIN_CHARS) & (F.length("text") > 0)).select("doc_id", "text").join(F.broadcast(few), "doc_id").select("quality", "h", "text").collect()
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r.h, r.text)):
        texts[r.quality].append(r.text.encode())
    if min(map(len, texts.values())) < 8:
        return None
    dicts = {}
    for label, found in texts.items():
        blocks = [t[a : a + BLOCK] for t in found[::2] for a in range(0, len(t), BLOCK)]
        size = min(DICT_BYTES, sum(map(len, blocks)) // 4)
        try:
            dicts[label] = zstandard.train_dictionary(size, blocks).as_bytes()
        except zstandard.ZstdError:  # too little to count: the text itself is the dictionary
            dicts[label] = b"".join(blocks)[-DICT_BYTES:]
    model = QualityModel(dicts[1], dicts[0], np.zeros(1), np.ones(1), np.zeros(1))
    good, bad = model.compressors()
    x = np.array([evidence(t, good, bad) for k in (0, 1) for t in texts[k][1::2]])
    y = np.array([k for k in (0, 1) for _ in texts[k][1::2]], float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return QualityModel(dicts[1], dicts[0], mean, scale, _curve((x - mean) / scale, y))


def score_quality(docs: DataFrame, model: QualityModel | None, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """(row, score), with_text: (row, text, score); row is a struct of the columns in ``keep`` (doc_id alone by default)."""
    spark = docs.sparkSession
    tune(spark)
    source = docs.select(F.struct(*(keep or ["doc_id"])).alias("row"), "text")
    if model is None:
        return source.select("row", *["text"] * with_text, F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    def run(batches):
        m = shared.value
        good, bad = m.compressors()
        for batch in batches:
            found = []
            for _, offs, data in text_chunks(batch, 1, 1):
                raw = data.tobytes()
                found += [evidence(raw[a:z], good, bad) for a, z in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + with_text], pa.array(m.score(np.array(found, float).reshape(-1, 5)))], names)

    fields = [source.schema["row"], *[source.schema["text"]] * with_text, StructField("score", DoubleType())]
    names = [f.name for f in fields]
    return source.mapInArrow(lean(run), StructType(fields))


def fold(column: str = "doc_id", n: int = 3):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def training_labels(labels: DataFrame) -> DataFrame:
    """Quality labels outside fold 1."""
    return labels.where(F.col("quality").isNotNull() & (fold() != 1)).select("doc_id", "quality")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score_quality(docs.select("doc_id", "text"), model)
    out = out.select("row.doc_id", "score")
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier predicts as bad go; the columns stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), training_labels(labels))
    kept = score_quality(docs, model, [c for c in docs.columns if c != "text"], with_text=True).where(F.col("score") >= 0.5)
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
