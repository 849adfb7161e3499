"""Centroid clustering of integer vectors: exact rounds, screened in float32.

A component x becomes floor(scale * x). Vectors stay in the tasks: each round a task takes its vectors batch by batch,
screens them against all centroids with one float32 matrix product, and sends one sum for each centroid and component.
The product's rounding error is bounded: whatever the order of additions, a float32 dot product of n terms is within
g(n) * |v| * |c| of the exact one, g(n) = n u / (1 - n u), u = 2^-24, with two more for the rounding of both factors. So
every |c|^2 - 2 v.c lies in an interval; where one centroid's interval ends before all others begin it is the nearest,
elsewhere the centroids whose intervals reach below the least upper end are compared in exact integers, and the smallest
number wins ties. Sums are exact: a task adds integers and sends them in limbs of 32 bits.

What meets the driver: the centroids and, for each round, their sums, k * dim integers. Vectors of which a component is
beyond 2^26 take part by Python's integers, at any magnitude.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; rows
without a vec_id are clustered, and are starts only after all others; rows that repeat a vec_id count each, among starts
in the order of their components; with fewer vectors than centroids there are fewer centroids; a centroid that loses all its
vectors stays; a distance, or a sum of distances, that doesn't fit a long is null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import checkpointed, lean, tune

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Components up to this size are added and squared in 64-bit integers, for up to 512 of them.
SMALL = 1 << 26
#: Rows that a task compares at once.
BLOCK = 4096
_U32 = 2.0**-24


def to_integer(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    n, d = float(x).as_integer_ratio()
    return n * scale // d


def _integers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, small, big) of the vectors that take part: components as 64-bit integers, or where one is too large as text."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore"):
                y = np.floor(x * scale) if math.frexp(scale)[0] == 0.5 else np.full_like(x, np.inf)  # a power of two scales without rounding
            fits = (np.abs(y) <= SMALL).all(1)
            small = np.where(fits[:, None], y, 0).astype(np.int64)
            big: list[str | None] = [None] * len(x)
            for k in np.flatnonzero(~fits):
                exact = [to_integer(v, scale) for v in x[k]]
                if max(map(abs, exact)) <= SMALL:
                    fits[k], small[k] = True, exact
                else:
                    big[k] = json.dumps(exact)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() if f else None for r, f in zip(small, fits, strict=True)], pa.binary()), pa.array(big, pa.string())], ["vec_id", "small", "big"])

    return rows.where(usable).mapInArrow(lean(run), "vec_id long, small binary, big string")


class Centroids:
    """Nearest centroids, exactly. centroids: lists of integers."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.small = max((abs(x) for c in centroids for x in c), default=0) <= SMALL
        self.ints = np.array(centroids, np.int64).reshape(len(centroids), len(centroids[0]) if centroids else 0) if self.small else None
        if self.small:
            wide = self.ints.astype(np.float64)
            self.f32 = np.ascontiguousarray(wide.astype(np.float32).T)
            self.squares = (self.ints * self.ints).sum(1).astype(np.float64)
            self.norms = np.sqrt(self.squares)

    def intervals(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|^2 - 2 v.c for each vector and centroid; v: small integers."""
        n = v.shape[1] + 2
        g = n * _U32 / (1 - n * _U32)
        middle = self.squares - 2.0 * (v.astype(np.float32) @ self.f32).astype(np.float64)
        long = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        # 2^-40 of all magnitudes covers what the few operations in double precision round away
        err = 2.0 * g * long[:, None] * self.norms + 2.0**-40 * (self.squares + 2 * long[:, None] * self.norms) + 2.0**-40
        return middle - err, middle + err

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each row of small integers, and how many rows needed exact comparisons."""
        low, high = self.intervals(v)
        open_ = low <= high.min(1)[:, None]
        best = open_.argmax(1)
        several = np.flatnonzero(open_.sum(1) > 1)
        for a in range(0, len(several), 512):
            k = several[a : a + 512]
            d = v[k][:, None, :] - self.ints[None, :, :]
            exact = (d * d).sum(2)
            exact[~open_[k]] = np.iinfo(np.int64).max
            best[k] = exact.argmin(1)  # the first of equals
        d = v - self.ints[best]
        return best, (d * d).sum(1), len(several)

    def nearest_big(self, v: list[int]) -> tuple[int, int]:
        found = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in self.exact]
        best = min(range(len(found)), key=found.__getitem__)
        return best, found[best]

    def assign(self, small: pa.Array, big: pa.Array, dim: int):
        """(vectors as an integer matrix or None, their centroids, their distances) of slices of a batch."""
        is_small = small.is_valid().to_numpy(zero_copy_only=False)
        for a in range(0, len(small), BLOCK):
            at = a + np.flatnonzero(is_small[a : a + BLOCK])
            v = np.frombuffer(b"".join(small.take(pa.array(at)).to_pylist()), np.int64).reshape(-1, dim)
            if self.small:
                if len(at):
                    yield at, v, *self.nearest(v)[:2]
            else:
                for k, row in zip(at, v.tolist(), strict=True):
                    yield (np.array([k]), row, *self.nearest_big(row))
        for k in np.flatnonzero(~is_small):
            row = json.loads(big[int(k)].as_py())
            yield (np.array([k]), row, *self.nearest_big(row))


def limbs(x: int) -> list[int]:
    """x = sum of limb k times 2^(32 k); only the last may be negative."""
    out = []
    while not -(1 << 31) <= x < 1 << 31:
        out.append(x & 0xFFFFFFFF)
        x >>= 32
    return [*out, x]


def _sums(vectors: DataFrame, centroids: list[list[int]], dim: int) -> tuple[list[int], list[list[int]]]:
    """Members of each centroid, and the sums of their components."""
    k = len(centroids)

    def run(batches):
        near = Centroids(centroids)
        sums, held, held_rows = [[0] * dim for _ in range(k)], np.zeros((k, dim), np.int64), 0
        counts = [0] * k

        def settle():
            for c in range(k):
                sums[c] = [a + b for a, b in zip(sums[c], held[c].tolist(), strict=True)]
            held[:] = 0

        for batch in batches:
            for _, v, cluster, _ in near.assign(batch.column(0), batch.column(1), dim):
                if isinstance(v, np.ndarray):
                    for c in np.unique(cluster).tolist():
                        mine = v[cluster == c]
                        held[c] += mine.sum(0)
                        counts[c] += len(mine)
                    held_rows += len(v)
                    if held_rows > 1 << 30:
                        settle()
                        held_rows = 0
                else:
                    sums[cluster] = [a + b for a, b in zip(sums[cluster], v, strict=True)]
                    counts[cluster] += 1
        settle()
        rows = [(c, -1, 0, counts[c]) for c in range(k) if counts[c]]
        rows += [(c, d, at, value) for c in range(k) if counts[c] for d in range(dim) for at, value in enumerate(limbs(sums[c][d])) if value]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "d", "limb", "value"])

    found = vectors.select("small", "big").mapInArrow(lean(run), "c int, d int, limb int, value long").groupBy("c", "d", "limb").agg(F.sum("value").alias("value"))
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    for r in found.collect():  # k * (dim + 1) numbers, of a few limbs each
        if r.d < 0:
            counts[r.c] += r.value
        else:
            sums[r.c][r.d] += r.value << (32 * r.limb)
    return counts, sums


def _starts(vectors: DataFrame, k: int, seed: str, dim: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "small", "big").limit(k).collect()
    return [np.frombuffer(r.small, np.int64).tolist() if r.small is not None else json.loads(r.big) for r in rows]


def cluster_vectors(table: DataFrame, dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector that takes part, written; the centroids). table: (vec_id, embedding)."""
    tune(table.sparkSession)
    vectors = checkpointed(_integers(table, dim, scale))
    centroids = _starts(vectors, k, seed, dim)
    for _ in range(rounds if centroids else 0):
        counts, sums = _sums(vectors, centroids, dim)
        moved = [[s // n for s in own] if n else old for n, own, old in zip(counts, sums, centroids, strict=True)]
        if moved == centroids:
            break  # all later rounds would do the same
        centroids = moved

    def run(batches):
        near = Centroids(centroids)
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [0] * batch.num_rows
            for at, _, c, d in near.assign(batch.column(1), batch.column(2), dim):
                cluster[at] = c
                for j, x in zip(at.tolist(), d.tolist() if isinstance(d, np.ndarray) else [d], strict=True):
                    distance[j] = x if x < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return checkpointed(vectors.mapInArrow(lean(run), "vec_id long, cluster int, distance long")), centroids


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    # a row for each centroid
    sums = {r.cluster: r for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), (F.count("*") == F.count("distance")).alias("whole")).collect()}
    long = lambda known: int(sum(r.total for r in known)) if all(r.whole for r in known) and sum(r.total for r in known) < 1 << 63 else None
    inertia = long(sums.values())
    found = [(n, long([sums[n]]) if n in sums else 0, inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids)]
    known = F.broadcast(spark.createDataFrame(found, "c int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return rows.join(known, F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """All rounds as a chain of tables; components are rows."""
    floor_div = "((s - ((s % n) + n) % n) // n)"
    parts = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(range({DIM})) AS d, unnest(list_transform(e, lambda y: floor({SCALE} * y::DOUBLE)::HUGEINT)) AS x FROM v),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR) NULLS LAST) - 1 AS c FROM v QUALIFY c < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT c, d, x AS y FROM first JOIN x USING (r))"""
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, c, dist FROM (SELECT r, c, sum((x - y) * (x - y)) AS dist FROM x JOIN c{k} USING (d) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)""")
        if k < ROUNDS:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT c, d, coalesce({floor_div}, y) AS y FROM c{k} LEFT JOIN (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{k} JOIN x USING (r) GROUP BY c, d) USING (c, d))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c) USING (c)"""


OP13_SQL = _sql()
