"""Near-duplicate embeddings: a navigable small-world graph per shard, every vector asked of every shard.

Equal vectors are one representative with a count. Representatives are dealt to shards by hash; each shard's
graph is built in a task and audited: beams widen until turned copies of its own vectors are found, and a shard whose
audit fails at the widest beam is searched exactly, in blocks. Every link is verified by cosine in double precision; a
link that either vector's search finds counts for both. Links of a vector with over DENSE of them in a shard leave the
task as a number, others as pairs; what joins them is reduced to a forest before it leaves, and components are joined by
contraction. Shards and the parts of the queries that meet one are bounded in rows and bytes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and
themselves as component; vectors of different lengths aren't compared; equal vectors link; rows without a vec_id link
with nothing, have no component and aren't kept; an empty table gives no rows; extra columns are ignored. vec_id
identifies a vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import checkpointed, groups_of, join_classes, lean, mix64, pack, tune, unpack
from speechlake.llm.components import COMPONENTS_SQL, connected_components, forest
from speechlake.llm.hnsw import Index, unit

COSINE = 0.9
#: Least number of shards; most vectors and bytes of one on average; queries of a block; most bytes of the queries that meet a shard in one task, and least parts of them.
SHARDS, SHARD_ROWS, SHARD_BYTES, BLOCK, PART_BYTES, PARTS = 6, 50_000, 64 << 20, 1024, 32 << 20, 4
#: Beam to begin with, share of turned copies that must be found, widest beam tried before a shard is searched exactly.
BEAM, RECALL, WIDEST = 32, 0.99, 2048
#: Links of a vector in a shard up to which they are pairs.
DENSE = 32


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _shard(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _exact(vectors: np.ndarray, q: np.ndarray, least: float):
    """As Index.within, by comparing a block of queries with all vectors."""
    for at in range(0, len(q), 128):
        close = q[at : at + 128] @ vectors.T >= least
        for k in np.flatnonzero(close.any(1)):
            yield at + int(k), np.flatnonzero(close[k])


def _links(vectors: DataFrame, n_shards: int, n_parts: int, cosine: float, recall: float) -> DataFrame:
    """(kind, a, b, shard, n). kind 0: vectors a and b link, b lies in the shard and stands for n copies; kind 1: links that join what is linked; kind 2: a links with n vectors of the shard. vectors: (vec_id, copies, embedding)."""
    blobs = vectors.select("vec_id", "copies", "embedding")

    def deal(batches):
        for batch in batches:
            ids, copies, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), unit(_matrix(batch.column(2)))
            rows = []
            for s, at in groups_of(_shard(ids, n_shards)):
                for a in range(0, len(at), BLOCK):
                    k = at[a : a + BLOCK]
                    rows.append((s, int(ids[k[0]]), pack(ids[k], copies[k], x[k], level=None)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "at", "blob"])

    dealt = checkpointed(blobs.mapInArrow(lean(deal), "shard int, at long, blob binary"))

    def build(table: pa.Table) -> pa.Table:
        parts = [unpack(b, np.int64, np.int64, np.float64) for b in table.column("blob").to_pylist()]
        ids, copies = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        x = np.concatenate([p[2].reshape(len(p[0]), -1) for p in parts])
        order = np.argsort(ids)
        index, beam = Index(np.ascontiguousarray(x[order])), BEAM
        while beam and index.audit(cosine, beam) < recall:
            beam = 2 * beam if beam < WIDEST else 0  # 0: no beam is wide enough
        return pa.table({"shard": table.column("shard").slice(0, 1), "index": pa.array([pack(ids[order], copies[order], np.array([beam]), index.dumps(), level=None)], pa.binary())})

    indexes = checkpointed(dealt.select("shard", "blob").groupBy("shard").applyInArrow(build, "shard int, index binary"))
    parts = indexes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "index")
    asked = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.pmod(F.xxhash64("at", "shard"), F.lit(n_parts)).cast("int").alias("part"), "blob")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        rows: list[tuple] = []  # kind, a, b, shard, n
        for raw in left.column("index").to_pylist():
            ids, copies, beam, dumped = unpack(raw, np.int64, np.int64, np.int64, bytes)
            index = Index.loads(dumped)
            u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for blob in right.column("blob").to_pylist():
                q_ids, q_copies, q = unpack(blob, np.int64, np.int64, np.float64)
                q, own, x, y = q.reshape(len(q_ids), -1), _shard(q_ids, n_shards), [u], [v]
                for k, hit in index.within(q, cosine, int(beam[0])) if beam[0] else _exact(index.vectors, q, cosine):
                    hit = hit[ids[hit] != q_ids[k]]
                    me = np.full(len(hit), q_ids[k])
                    x.append(me)
                    y.append(ids[hit])
                    if 0 < len(hit) <= DENSE:
                        rows.append((0, me, ids[hit], shard, copies[hit]))
                        rows.append((0, ids[hit], me, int(own[k]), np.full(len(hit), q_copies[k])))
                    elif len(hit):
                        rows.append((2, me[:1], me[:1], shard, copies[hit].sum(keepdims=True)))
                    if sum(map(len, x)) > 500_000:
                        u, v = forest(np.concatenate(x), np.concatenate(y))
                        x, y = [u], [v]
                u, v = forest(np.concatenate(x), np.concatenate(y))
            rows.append((1, u, v, shard, np.zeros(len(u), np.int64)))
        each = lambda k, t: pa.array(np.concatenate([np.full(len(r[1]), r[k], t) for r in rows]) if rows else np.zeros(0, t))
        flat = lambda k: pa.array(np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64))
        return pa.table({"kind": each(0, np.int32), "a": flat(1), "b": flat(2), "shard": each(3, np.int32), "n": flat(4)})

    return parts.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(ask, "kind int, a long, b long, shard int, n long")


def _counts(found: DataFrame) -> DataFrame:
    """(counted, others): how many vectors each representative links with, those of its own class apart."""
    pairs = found.where("kind = 0").select("a", "b", "shard", "n").distinct().select("a", "shard", "n", F.lit(None).cast("long").alias("whole"))
    dense = found.where("kind = 2").select("a", "shard", F.lit(0).cast("long").alias("n"), F.col("n").alias("whole"))
    shards = pairs.unionByName(dense).groupBy("a", "shard").agg(F.coalesce(F.max("whole"), F.sum("n")).alias("n"))
    return shards.groupBy(F.col("a").alias("counted")).agg(F.sum("n").alias("others"))


def embedding_components(table: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; table: (vec_id, embedding)."""
    spark = table.sparkSession
    tune(spark)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"))
    big = F.lit(float("inf"))
    usable = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("embedding", lambda x: x != 0)
    digest = [F.when(usable & F.col("vec_id").isNotNull(), F.xxhash64(F.lit(k), "embedding")).alias(f"h{k}") for k in (1, 2)]
    good = rows.where(F.col("vec_id").isNotNull() & usable)
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    representatives = checkpointed(classes.select(F.col("first").alias("vec_id"), "copies", "embedding", *[F.xxhash64(F.lit(k), "embedding").alias(f"c{k}") for k in (1, 2)]))
    found = []
    for r in representatives.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect():  # a row for each length
        size = 8 * r["dim"]
        shards = max(SHARDS, -(-r["n"] // SHARD_ROWS), -(-r["n"] * size // SHARD_BYTES))
        found.append(_links(representatives.where(F.size("embedding") == r["dim"]), shards, max(PARTS, -(-r["n"] * size // PART_BYTES)), cosine, recall))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = checkpointed(every)
    components = connected_components(every.where("kind = 1").select("a", "b"))
    known = representatives.select("vec_id", "copies", "c1", "c2").join(_counts(every), F.col("vec_id") == F.col("counted"), "left").join(components, F.col("vec_id") == F.col("node"), "left")
    known = checkpointed(known.select(F.col("c1").alias("h1"), F.col("c2").alias("h2"), "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "vec_id").alias("c")))
    out = join_classes(rows.select("vec_id", *digest), known, ["h1", "h2"], ["n", "c"], F.xxhash64("vec_id"))
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP7_SQL = (
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
both_ways AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings),
"""
    + COMPONENTS_SQL
    + """
SELECT e.vec_id, count(b.y) AS n_links, any_value(c.c) AS component_id, any_value(c.c) = e.vec_id AS kept
FROM embeddings e JOIN component c ON c.node = e.vec_id LEFT JOIN both_ways b ON b.x = e.vec_id GROUP BY e.vec_id"""
)
