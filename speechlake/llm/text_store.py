"""Whole texts dealt once by document, compressed, and kept in the shared folder.

Later passes meet the texts where they lie: messages are keyed by the bucket of the document they concern and
joined to the store's partitions without moving texts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import bucket_of, checkpointed, groups_of, lean, n_buckets, pack, ragged, text_chunks, trim, tune, unpack, without_aqe

#: Text bytes that a mapper gathers before it writes one compressed part for each bucket.
GATHER_BYTES = 1 << 23


def take(offs: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of some rows."""
    lens = (offs[1:] - offs[:-1])[rows]
    return np.concatenate([[0], np.cumsum(lens)]), data[ragged(offs[:-1][rows], lens)]


def distinct_documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """((doc_id, text) with one row for each doc_id, whether any was repeated).

    Ids alone are counted; only where some repeat are texts grouped, to the one that sorts first. Rows without a
    doc_id are no documents.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return (docs.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else docs), repeated


def with_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs with a key of its own for each row, the key's name): doc_id where no row lacks or repeats it; else a number by doc_id, rows without one last, then text, in a written table."""
    ids = docs.select("doc_id")
    if ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, "doc_id"
    key = "_key" + "_" * max((len(c) for c in docs.columns), default=0)
    ordered = docs.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), F.col("text").asc_nulls_first())
    return checkpointed(ordered.withColumn(key, F.monotonically_increasing_id())), key


def for_each_row(result: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """result, with a row for each row of docs where doc_ids are repeated."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).join(result, "doc_id") if repeated else result


def build_store(docs: DataFrame) -> tuple[DataFrame, int]:
    """((b, blob), buckets): checkpointed, hash partitioned by b. docs: (doc_id, text), each doc_id once."""
    spark = docs.sparkSession
    tune(spark)
    n = n_buckets(spark)

    def deal(batches):
        held, size = [], 0

        def out():
            ids = np.concatenate([h[0] for h in held])
            lens = np.concatenate([np.diff(h[1]) for h in held])
            offs, data = np.concatenate([[0], np.cumsum(lens)]), np.concatenate([h[2] for h in held])
            keys, blobs = [], []
            for b, rows in groups_of(bucket_of(ids, n)):
                o, d = take(offs, data, rows)
                keys.append(b)
                blobs.append(pack(ids[rows], np.diff(o).astype("<u4"), d, level=3))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["b", "blob"])

        for batch in batches:
            for ids, offs, data in text_chunks(batch):
                held.append((np.array(ids, np.int64), np.array(offs), np.array(data)))
                size += len(data) + 64 * len(ids)
                if size >= GATHER_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = docs.select("doc_id", "text").mapInArrow(lean(deal), "b int, blob binary")
    with without_aqe(spark):
        return checkpointed(rows.repartition(n, "b"), keep_partitioning=True), n


def read_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes) of one part of the store."""
    ids, lens, data = unpack(blob, np.int64, "<u4", np.uint8)
    return ids, np.concatenate([[0], np.cumsum(lens.astype(np.int64))]), data


def with_messages(store: DataFrame, messages: DataFrame, function, schema: str = "b int, blob binary", fields: pa.Schema | None = None, columns: bool = False) -> DataFrame:
    """function(list of the store's blobs, list of message blobs) -> rows, for each bucket; messages: (b, blob). fields: of the rows, where they aren't (b, blob). columns: function returns whole columns instead."""
    fields = fields or pa.schema([("b", pa.int32()), ("blob", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = function(left.column("blob").to_pylist(), right.column("blob").to_pylist())
        rows = rows if columns else list(rows)
        out = pa.table([pa.array(rows[k] if columns else [x[k] for x in rows], f.type) for k, f in enumerate(fields)], schema=fields)
        del rows
        trim()
        return out

    return store.groupBy("b").cogroup(messages.groupBy("b")).applyInArrow(run, schema)
