"""Nearest neighbours by inner product: stable projections of few dimensions in kd-trees, verified until a chi-square test stops.

Vectors are dealt to shards by a hash of their row. In a shard equal vectors are one point with its smallest ids, points
of like length (a power of two) form a band, and a band's vectors get one component more, sqrt(M^2 - |x|^2) with M the
longest of the band, so that the largest inner product is the smallest Euclidean distance. A point's projections onto
PROJECTED Gaussian directions lie in a kd-tree. For a query, squared projected distance over squared distance is chi-square
distributed with PROJECTED degrees of freedom, so a point that is nearer than the k-th best found so far lies beyond a
projected distance of sqrt(quantile) times that one's distance with a chance of 1 - CONFIDENCE only. The search takes
the tree's leaves in the order of their projected distance, verifies points by inner products in double precision
wherever one lies within that bound, and stops at the first leaf beyond it; the bound shrinks as better neighbours are
found. Queries walk in blocks, so that those which come to a leaf in the same turn share a matrix product.

A cell is a part of the queries and a share of the shards: its queries come first and its indexes stream past, one in
memory at a time, so that what one shard has found stops the search in the next one early. Cells send k + 1 rows a
distinct query. The grid is as small as the queries' bytes and the cluster's tasks allow, as indexes are copied to every part of
the queries. Every vector is in an index; directions come from a seed, not from data.

Scores are sums from the first component to the last in double precision, so that equal vectors tie exactly; ties go to
the smaller vec_id. Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a vec_id, take no part; vectors of different lengths aren't compared; where rows share a vec_id, a query leaves
out one row with its own id and vector, and each of the rows is a query; vectors whose squared length overflows or
vanishes in double precision are compared with every query, and scores that aren't numbers are no result; a query with
fewer candidates than k gets all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.llm.common import checkpointed, groups_of, lean, n_buckets, pack, tune, unpack

K, EVERY = 20, 20
#: Dimensions of a projection; chance that a true neighbour lies within the bound.
PROJECTED, CONFIDENCE, SEED = 16, 0.99, 20240611
#: Rows and bytes of a shard at most, on average, and rows at least where shards are only made to fill the tasks; points of a leaf; bytes of the queries that a cell holds, and queries that go through a tree together.
SHARD_ROWS, SHARD_BYTES, LEAST_ROWS, LEAF, PART_BYTES, BLOCK = 50_000, 64 << 20, 500, 256, 32 << 20, 2048


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with a chance of p that a chi-square variable of an even number of degrees is at most x."""
    assert degrees % 2 == 0
    low, high = 0.0, 1000.0 + 10 * degrees
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for k in range(1, degrees // 2):
            term *= x / 2 / k
            total += term
        low, high = (x, high) if 1 - np.exp(-x / 2) * total < p else (low, x)
    return high


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, added from the first component to the last."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.add.accumulate(x * q, axis=1)[:, -1]


# ---------------------------------------------------------------- one shard


def directions(dim: int, projected: int, seed: int) -> np.ndarray:
    """Gaussian directions; the last row is that of the added component."""
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, projected))


class Tree:
    """A kd-tree over projected points: nodes split the widest side at its median."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        spans, kids, low, high = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me, mine = len(spans), points[order[a:b]]
            spans.append((a, b))
            kids.append([-1, -1])
            low.append(mine.min(0))
            high.append(mine.max(0))
            if parent >= 0:
                kids[parent][side] = me
            wide = int((high[-1] - low[-1]).argmax())
            if b - a > leaf and high[-1][wide] > low[-1][wide]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(mine[:, wide], half)]
                todo += [(a + half, b, me, 1), (a, a + half, me, 0)]
        self.order, self.spans, self.kids = order, np.array(spans, np.int64), np.array(kids, np.int64)
        self.low, self.high = np.array(low), np.array(high)

    def arrays(self) -> list[np.ndarray]:
        return [self.spans, self.kids, self.low, self.high]


class Band:
    """Points of like length with their tree; points lie in the tree's order."""

    def __init__(self, vectors, points, spans, kids, low, high, longest):
        self.x, self.points = vectors, points
        self.spans, self.kids, self.low, self.high, self.longest = spans, kids, low, high, longest

    def search(self, q: np.ndarray, units: np.ndarray, lengths: np.ndarray, spots: np.ndarray, quantile: float, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, place, score) of points that may be among the k best and reach ``worst``, and how many were verified. spots: the queries' projections, in the band's length.

        Each query takes the leaves in the order of their projected distance. A round takes one leaf for each query that
        has not stopped, and queries that have come to the same leaf are verified together.
        """
        order, near = self._leaves(spots)
        best, thr = np.full((len(q), k), -np.inf), worst.copy()
        live, verified, kept = np.arange(len(q)), 0, []
        for turn in range(order.shape[1]):
            # squared distance, in the band's geometry, of a point with the k-th best score
            with np.errstate(invalid="ignore"):
                bound = np.where(np.isneginf(thr), np.inf, quantile * np.maximum(0, 2 * self.longest * (self.longest - thr / lengths)) * (1 + 1e-9) + 1e-9 * self.longest**2)
            live = live[near[live, turn] <= bound[live]]
            if not len(live):
                break
            for leaf, at in groups_of(order[live, turn]):
                mine, (a, b) = live[at], self.spans[leaf]
                points = self.points[a:b]
                gap = (spots[mine] ** 2).sum(1)[:, None] + (points**2).sum(1) - 2 * spots[mine] @ points.T
                within = gap <= bound[mine][:, None] + 1e-9 * self.longest**2
                mine, cols = mine[within.any(1)], np.flatnonzero(within.any(0))
                if not len(mine):
                    continue
                scores = q[mine] @ (self.x[a:b] if len(cols) == b - a else self.x[a + cols]).T
                verified += scores.size
                best[mine] = np.partition(np.concatenate([best[mine], scores], axis=1), -k, axis=1)[:, -k:]
                thr[mine] = np.maximum(thr[mine], best[mine].min(1))
                rows, close = np.nonzero(scores >= (thr[mine] - 1e-12 * self.longest * lengths[mine])[:, None])
                kept.append((mine[rows], a + cols[close], scores[rows, close]))
        if not kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), verified
        query, place, score = (np.concatenate(c) for c in zip(*kept, strict=True))
        still = score >= thr[query] - 1e-12 * self.longest * lengths[query]
        query, place = query[still], place[still]
        return query, place, dots(self.x[place], q[query]), verified

    def _leaves(self, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's leaves, the nearest first, and their squared distances."""
        leaves = np.flatnonzero(self.kids[:, 0] < 0)
        gap = np.zeros((len(spots), len(leaves)))
        for d in range(spots.shape[1]):
            side = np.maximum(self.low[leaves, d] - spots[:, d, None], spots[:, d, None] - self.high[leaves, d])
            gap += np.maximum(0, side) ** 2
        by = np.argsort(gap, axis=1, kind="stable")
        return leaves[by], np.take_along_axis(gap, by, 1)


def build(ids: np.ndarray, x: np.ndarray, projected: int, seed: int, k: int) -> bytes:
    """A shard's index. Ids of equal vectors: the smallest k + 1, which are all that any result can hold."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)])
    sizes = np.diff(np.r_[first, len(x)])
    x = x[first]
    with np.errstate(over="ignore"):
        squares = np.einsum("ij,ij->i", x, x)
    plain = np.isfinite(squares) & (squares > 1e-300)
    band = np.where(plain, np.frexp(np.sqrt(np.where(plain, squares, 1.0)))[1], 1 << 20)
    r, parts = directions(x.shape[1], projected, seed), []
    for b in np.unique(band)[::-1]:  # the longest first
        at = np.flatnonzero(band == b)
        longest, arrays = 0.0, [np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64), np.zeros((0, projected)), np.zeros((0, projected))]
        points = np.zeros((0, projected))
        if b != 1 << 20:
            longest = float(np.sqrt(squares[at].max()))
            last = np.sqrt(np.maximum(0, longest**2 - squares[at]))
            points = x[at] @ r[:-1] + last[:, None] * r[-1]
            tree = Tree(points)
            at, points, arrays = at[tree.order], points[tree.order], tree.arrays()
        many = np.minimum(sizes[at], k + 1)
        starts = np.cumsum(many) - many
        own = ids[np.repeat(first[at] - starts, many) + np.arange(many.sum())]
        parts += [x[at], own, np.r_[starts, many.sum()], points, *arrays, np.array([longest])]
    return pack(np.array([x.shape[1]]), *parts, level=None)


def load(blob: bytes, projected: int) -> list[tuple[Band, np.ndarray, np.ndarray]]:
    """(band, ids, where each point's ids begin) of each band."""
    kinds = [np.float64, np.int64, np.int64, np.float64, np.int64, np.int64, np.float64, np.float64, np.float64]
    n = int.from_bytes(blob[1:5], "little") // len(kinds)
    (dim,), *parts = unpack(blob, np.int64, *kinds * n)
    out = []
    for k in range(0, len(parts), 9):
        x, ids, starts, points, spans, kids, low, high, longest = parts[k : k + 9]
        band = Band(x.reshape(-1, dim), points.reshape(-1, projected), spans.reshape(-1, 2), kids.reshape(-1, 2), low.reshape(-1, projected), high.reshape(-1, projected), float(longest[0]))
        out.append((band, ids, starts))
    return out


class Asked:
    """The distinct queries of a cell and the best that each has found."""

    def __init__(self, vectors: np.ndarray, k: int, projected: int, seed: int, quantile: float):
        self.q, self.k, self.quantile = vectors, k, quantile
        with np.errstate(over="ignore"):
            self.lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.plain = np.isfinite(self.lengths) & (self.lengths > 1e-150)
        self.r = directions(vectors.shape[1], projected, seed)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(vectors)
        self.verified = 0

    def meet(self, bands: list) -> None:
        with np.errstate(invalid="ignore"):
            units = self.q / np.where(self.plain, self.lengths, 1.0)[:, None]
        spots = units @ self.r[:-1]
        for band, ids, starts in bands:
            for a in range(0, len(self.q), BLOCK):
                block = np.arange(a, min(a + BLOCK, len(self.q)))
                worst = np.array([self.best[n][0][-1] if len(self.best[n][0]) == self.k else -np.inf for n in block])
                plain = self.plain[block] & bool(len(band.spans))
                # a band without a point that is long enough is passed over
                some = plain & (worst <= band.longest * self.lengths[block] * (1 + 1e-12))
                mine = block[some]
                if len(mine):
                    at, place, score, done = band.search(self.q[mine], units[mine], self.lengths[mine], spots[mine] * band.longest, self.quantile, worst[some], self.k)
                    self.verified += done
                    for j, rows in groups_of(at):
                        self._merge(int(mine[j]), place[rows], score[rows], ids, starts)
                for n in block[~plain]:
                    self.verified += len(band.x)
                    self._merge(int(n), np.arange(len(band.x)), dots(band.x, self.q[n]), ids, starts)

    def _merge(self, n: int, at: np.ndarray, found: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        good = ~np.isnan(found)
        at, found = at[good], found[good]
        many = starts[at + 1] - starts[at]
        where = np.repeat(starts[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        scores, mine = np.concatenate([self.best[n][0], np.repeat(found, many)]), np.concatenate([self.best[n][1], ids[where]])
        top = np.lexsort((mine, -scores))[: self.k]
        self.best[n] = scores[top], mine[top]


# ---------------------------------------------------------------- all shards


def _grid(n: int, dim: int, asked: int, k: int, tasks: int) -> tuple[int, int, int]:
    """(shards, parts of the queries, shares of the shards). Indexes go to every part and results come from every share: parts are chosen for the fewest bytes of both."""
    index, results = n * (8 * dim + 192), asked * (k + 1) * 32
    parts = max(1, -(-8 * asked * dim // PART_BYTES), round((tasks * results / max(1, index)) ** 0.5))
    shares = max(1, min(-(-tasks // parts), n // LEAST_ROWS))
    shards = max(shares, -(-n // SHARD_ROWS), -(-8 * n * dim // SHARD_BYTES))
    return shards, parts, shares


def _search(vectors: DataFrame, dim: int, n: int, asked: int, k: int, projected: int, confidence: float, seed: int) -> DataFrame:
    """(row, query_id, vec_id, score, own): of each share of the vectors, the k + 1 best found for each query. vectors: (row, vec_id, embedding, asks), of one length, written."""
    shards, parts, shares = _grid(n, dim, asked, k, n_buckets(vectors.sparkSession))
    quantile = chi_square_quantile(confidence, projected)

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)

    def index(table: pa.Table) -> pa.Table:
        x = matrix(table.column("embedding").combine_chunks())
        return pa.table({"shard": table.column("shard").slice(0, 1), "blob": pa.array([build(table.column("vec_id").to_numpy(), x, projected, seed, k)], pa.binary())})

    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    indexes = checkpointed(vectors.select(shard.alias("shard"), "vec_id", "embedding").groupBy("shard").applyInArrow(index, "shard int, blob binary"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cell = (F.col("part") * shares + F.col("share")).cast("int").alias("cell")
    # equal queries meet in few parts, so that each is searched once in a cell
    part = F.pmod(F.xxhash64("embedding", F.pmod(F.xxhash64("row"), F.lit(8))), F.lit(parts))
    queries = vectors.where("asks").select(part.alias("part"), "row", "vec_id", "embedding").select("*", every(shares).alias("share"))
    streams = indexes.select("shard", "blob", F.pmod("shard", F.lit(shares)).alias("share")).select("*", every(parts).alias("part"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = queries.select(cell, F.lit(-1).alias("shard"), "row", "vec_id", "embedding", none("binary", "blob")).unionByName(streams.select(cell, "shard", none("long", "row"), none("long", "vec_id"), none("array<double>", "embedding"), "blob"))

    def ask(batches):
        now, rows, ids, x, held, own = None, [], [], [], None, None

        def answers():
            if held is None:
                return
            row, name = np.concatenate(rows), np.concatenate(ids)
            self_scores = np.array([dots(q[None, :], q)[0] for q in held.q])
            for a in range(0, len(row), 1024):
                mine = own[a : a + 1024]
                found = [held.best[j] for j in mine]
                many = [len(f[0]) for f in found]
                scores, near = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                asker = np.repeat(name[a : a + 1024], many)
                same = (near == asker) & (scores == np.repeat(self_scores[mine], many))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row[a : a + 1024], many)), pa.array(asker), pa.array(near), pa.array(scores), pa.array(same)], ["row", "query_id", "vec_id", "score", "own"])

        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in _runs(cells, kinds):
                if cells[a] != now:
                    yield from answers()
                    now, rows, ids, x, held = cells[a], [], [], [], None
                if kinds[a] < 0:
                    rows.append(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64))
                    ids.append(batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64))
                    x.append(matrix(batch.column(4).slice(a, b - a)))
                elif ids:
                    if held is None:
                        distinct, own = np.unique(np.concatenate(x), axis=0, return_inverse=True)
                        own, x = own.reshape(-1), []
                        held = Asked(distinct, k + 1, projected, seed, quantile)
                    for blob in batch.column(5).slice(a, b - a):
                        held.meet(load(blob.as_py(), projected))
        yield from answers()

    streamed = both.repartitionByRange(parts * shares, "cell").sortWithinPartitions("cell", "shard")
    return streamed.mapInArrow(lean(ask), "row long, query_id long, vec_id long, score double, own boolean")


def _runs(cells: np.ndarray, kinds: np.ndarray):
    """Ranges of rows of one cell that are all queries or all indexes."""
    if len(cells):
        cut = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | ((kinds[1:] < 0) != (kinds[:-1] < 0))])
        yield from zip(cut.tolist(), np.r_[cut[1:], len(cells)].tolist(), strict=True)


def nearest_by_inner_product(table: DataFrame, asks: Column, k: int = K, projected: int = PROJECTED, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where asks. table: (vec_id, embedding); asks: a condition on its columns."""
    spark = table.sparkSession
    tune(spark)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"), F.coalesce(asks, F.lit(False)).alias("asks"))
    big = F.lit(float("inf"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("embedding", lambda x: x != 0)
    vectors = checkpointed(rows.where(usable)).withColumn("row", F.monotonically_increasing_id())
    found = None
    for r in vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).where("asked > 0").collect():  # a row for each length
        some = _search(vectors.where(F.size("embedding") == r.dim), r.dim, r.n, r.asked, k, projected, confidence, seed)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # at most k + 1 rows a share; the first row that is the query's own goes
    place = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    placed = found.withColumn("place", F.row_number().over(place))
    own = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("row"))
    ranked = placed.withColumn("mine", own).where(~F.col("place").eqNullSafe(F.col("mine")))
    rank = F.col("place") - F.when(F.col("place") > F.col("mine"), 1).otherwise(0)
    return ranked.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op12_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_by_inner_product(table, F.col("vec_id") % EVERY == 0)


#: All neighbours by brute force. The query finds them with a chance that its confidence bounds; on the small tables it finds all.
OP12_SQL = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= {K}"""
