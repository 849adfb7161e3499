"""Conflict-constrained best-fit packing of documents into training sequences.

Documents longer than a sequence are cut into full sequences and a rest. Items go to packing groups by hash, so
that every group is a bounded task; within a group, longest first, each item goes to the compatible bin with the
least room left. Bins are kept by residual, and below one residual by what they hold of each source: the
successor search goes to the next larger residual until a bin takes the item. A bin takes at most PER_SOURCE
documents of a source (unary counts in as many bitmaps) and one document of a duplicate cluster (a bitmap over
the clusters that the group holds several times).

Defined results: null texts and texts without words take no room and get no row; equal residuals go to the bin
opened first, equal lengths by cluster, source and doc_id; repeated rows are packed each (copies conflict, as one
cluster); a null source is a source of its own; rows without a doc_id are packed like others, behind those of equal
length, and come out without one; an empty table gives no rows; extra columns are ignored. Clusters are equal whole
texts unless a column says otherwise: near copies are no conflict.
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import checkpointed, digest64, ids_if_small, lean, runs, text_chunks, tune

#: Words of a sequence; most documents of a source in one; documents of a packing group, about.
CAPACITY, PER_SOURCE, GROUP_DOCS = 2048, 4, 4096
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


class Bins:
    """Open bins of one group, ordered by residual."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.present = 0  # bit r: there is a bin with residual r
        self.by_residual: list[dict[tuple, list[int]]] = [{} for _ in range(capacity + 1)]
        self.residual: list[int] = []
        self.planes: list[tuple[int, ...]] = []  # plane k has the sources of which the bin holds over k documents
        self.clusters: list[int] = []
        self.resume: tuple | None = None

    def _find(self, length: int, source: int, cluster: int, start: int) -> tuple[int, int]:
        """(bin, residual) of the tightest compatible bin, (-1, 0) if there is none; residuals below ``start`` are known not to have one."""
        rest = self.present >> start
        r = start
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            best = -1
            for planes, bins in self.by_residual[r].items():
                if planes[-1] & source:
                    continue
                for b in bins:
                    if best >= 0 and b > best:
                        break
                    if not self.clusters[b] & cluster:
                        best = b
                        break
            if best >= 0:
                return best, r
            rest >>= step + 1
            r += 1
        return -1, 0

    def put(self, length: int, source_bit: int, cluster_bit: int) -> int:
        """The bin that an item goes to. Items come longest first."""
        key = (length, source_bit, cluster_bit)
        start = length
        if cluster_bit and self.resume and self.resume[0] == key:
            start = self.resume[1]  # bins below were tried for an equal item and have only filled up since
        b, r = self._find(length, source_bit, cluster_bit, start)
        if b < 0:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.planes.append((0,) * self.per_source)
            self.clusters.append(0)
            self.resume = (key, self.capacity + 1)
        else:
            self._leave(b)
            self.resume = (key, r)
        self.residual[b] -= length
        planes, k = list(self.planes[b]), 0
        while planes[k] & source_bit:
            k += 1
        planes[k] |= source_bit
        self.planes[b] = tuple(planes)
        self.clusters[b] |= cluster_bit
        self._enter(b)
        return b

    def _enter(self, b: int) -> None:
        r = self.residual[b]
        insort(self.by_residual[r].setdefault(self.planes[b], []), b)
        self.present |= 1 << r

    def _leave(self, b: int) -> None:
        r = self.residual[b]
        at = self.by_residual[r]
        bins = at[self.planes[b]]
        bins.remove(b)
        if not bins:
            del at[self.planes[b]]
        if not at:
            self.present &= ~(1 << r)


def pack_items(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each item; items must come in packing order (longest first)."""
    count: dict = {}
    for c in clusters:
        count[c] = count.get(c, 0) + 1
    bit: dict = {}
    for c, n in count.items():
        if n > 1:
            bit[c] = 1 << len(bit)
    source_bit: dict = {}
    bins = Bins(capacity, per_source)
    return [bins.put(n, source_bit.setdefault(s, 1 << len(source_bit)), bit.get(c, 0)) for n, s, c in zip(lengths, sources, clusters, strict=True)]


_ROWS = "doc_id long, piece int, first_word long, n_words long, pack_group int, bin int, bin_start long"


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row for each piece of a document: its words, its bin (within its packing group) and where in the bin it starts. docs: (doc_id, text, source).

    Duplicate clusters are equal whole texts, or what a column ``cluster`` (long) says where there is one.
    """
    spark = docs.sparkSession
    tune(spark)
    n_groups = max(1, math.ceil(docs.count() / group_docs))
    given = "cluster" in docs.columns

    def measure(batches):
        for batch in batches:
            at = 0
            for ids, offs, data in text_chunks(batch):
                _, _, words = runs(~_GAP[data], offs)
                cluster = batch.column(4).slice(at, len(ids)) if given else pa.array(digest64([data[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:], strict=True)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(2).slice(at, len(ids)), batch.column(3).slice(at, len(ids)), cluster, pa.array(words)], ["doc_id", "source", "g", "cluster", "words"])
                at += len(ids)

    # An id that more rows than a group's have is dealt over groups row by row; there are fewer such ids than groups.
    often = docs.groupBy(F.col("doc_id").cast("long").alias("_often")).agg(F.count("*").alias("n")).where((F.col("n") > group_docs) & F.col("_often").isNotNull()).select("_often")
    dealt_by_row = F.col("doc_id").isNull()
    if not often.isEmpty():
        docs = docs.join(ids_if_small(checkpointed(often)), docs["doc_id"].cast("long") == F.col("_often"), "left")
        dealt_by_row = dealt_by_row | F.col("_often").isNotNull()
    by = F.xxhash64(F.col("doc_id").cast("long"), F.when(dealt_by_row, F.monotonically_increasing_id()))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.pmod(by, F.lit(n_groups)).cast("int").alias("g")]
    measured = docs.select(*columns, *([F.coalesce(F.col("cluster").cast("long"), by).alias("cluster")] if given else [])).mapInArrow(lean(measure), "doc_id long, source string, g int, cluster long, words long")
    dealt = measured.where("words > 0")

    def pack(table: pa.Table) -> pa.Table:
        nameless = table.column("doc_id").is_null().to_numpy()
        ids = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        cluster, words = (table.column(c).to_numpy() for c in ("cluster", "words"))
        source = [x or "" if x is not None else None for x in table.column("source").to_pylist()]
        names = {s: k for k, s in enumerate(sorted({s for s in source if s is not None}), 1)}
        code = np.array([names.get(s, 0) for s in source])
        full, rest = words // capacity, words % capacity
        # Full pieces are bins by themselves.
        who = np.repeat(np.arange(len(ids)), full)
        piece = np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full)
        order = np.lexsort((piece, ids[who]))
        who, piece = who[order], piece[order]
        item = np.flatnonzero(rest)
        item = item[np.lexsort((ids[item], code[item], cluster[item], -rest[item]))]
        bins = np.array(pack_items(rest[item].tolist(), code[item].tolist(), cluster[item].tolist(), capacity, per_source), np.int64)
        fill = rest[item]
        turn = np.argsort(bins, kind="stable")
        before = np.cumsum(fill[turn]) - fill[turn]
        first = np.concatenate([[True], bins[turn][1:] != bins[turn][:-1]]) if len(bins) else np.zeros(0, bool)
        start = np.zeros(len(bins), np.int64)
        start[turn] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(bins)))) if len(bins) else 0
        row = np.concatenate([who, item])
        piece = np.concatenate([piece, full[item]])
        return pa.table({
            "doc_id": pa.array(ids[row], mask=nameless[row]), "piece": piece.astype(np.int32), "first_word": piece * capacity,
            "n_words": np.concatenate([np.full(len(who), capacity), fill]).astype(np.int64), "pack_group": pa.array(np.full(len(row), table.column("g")[0].as_py()), pa.int32()),
            "bin": np.concatenate([np.arange(len(who)), bins + len(who)]).astype(np.int32), "bin_start": np.concatenate([np.zeros(len(who), np.int64), start]),
        })

    return dealt.groupBy("g").applyInArrow(pack, _ROWS)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
