"""Merkle manifest of a corpus: a leaf for each row, a tree for each group, a tree over the groups' roots, and every row's path.

Rows are range partitioned by group and key; a row's place in its group follows from its place in its partition and one
number for each partition. Blocks of 2^HEIGHT consecutive leaves (aligned: a block is one node HEIGHT levels up) become
their roots, the roots are cut into blocks again until each group is one block, and the groups' roots are treated alike.
On the way down each block meets the path of its own root, and traversal scheduling walks its leaves: one treehash stack
for each level grows the node that its authentication path needs next, two steps a leaf and level, so that no block holds
more than a logarithm of nodes beside its leaves. Blocks are bounded, whatever a group's share of the rows.

A run of nodes is two consecutive ones, the last run of a level may be one; a run becomes the hash of its digests. A path
is a list with an entry for each level: L or R and the sibling's digest, or S where a run has no sibling. H is sha256 in
lowercase hex, of UTF-8 text; a null field is ``-``, others are their byte count, ``:`` and their value.

Defined results: rows whose group is null are a group, the first; rows without a key come first in their group; rows
with equal keys are ordered by their leaf, so that equal rows may change places (their leaves are equal) and every row
keeps a path of its own; empty and very long texts are hashed like any other; an empty table gives no rows; other columns
are ignored. Digests are shuffled, texts are not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import checkpointed, lean, tune

#: Levels of a block.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    sibling = lambda s: F.substring(s, 2, 64)
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.when(s.startswith("L"), F.concat(sibling(s), at)).when(s.startswith("R"), F.concat(at, sibling(s))).otherwise(at), 256))


# ---------------------------------------------------------------- one block


def _join(a: bytes | None, b: bytes | None) -> bytes | None:
    """The node above two; None: beyond the last leaf."""
    if a is None:
        return None
    return hashlib.sha256(a if b is None else a + b).hexdigest().encode()


class _Treehash:
    """Grows one node of a level from its leaves, a step at a time."""

    def __init__(self, level: int, leaves: list[bytes]):
        self.level, self.leaves, self.stack, self.done = level, leaves, [], True

    def begin(self, start: int) -> None:
        self.at, self.stack, self.done = start, [], False

    def low(self) -> int:
        """Level of the lowest node at work; that of the goal before the first step, beyond all when done."""
        if self.done:
            return 1 << 30
        return self.stack[-1][0] if self.stack else self.level

    def step(self) -> None:
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            level, b = self.stack.pop()
            _, a = self.stack.pop()
            self.stack.append((level + 1, _join(a, b)))
        else:
            self.stack.append((0, self.leaves[self.at] if self.at < len(self.leaves) else None))
            self.at += 1
        self.done = len(self.stack) == 1 and self.stack[0][0] == self.level

    def take(self) -> bytes | None:
        return self.stack[0][1]


def block_height(block: int, n: int, height: int) -> int:
    """Levels of a block of n nodes: block 0 that isn't full is all there is, any other is a part and one node ``height`` levels up."""
    return (n - 1).bit_length() if block == 0 and n < 1 << height else height


def block_root(leaves: list[bytes], height: int) -> bytes:
    for _ in range(height):
        leaves = [_join(leaves[k], leaves[k + 1] if k + 1 < len(leaves) else None) for k in range(0, len(leaves), 2)]
    return leaves[0]


def paths(leaves: list[bytes], height: int):
    """The path of each leaf up to the block's root, leaf by leaf: traversal scheduling with a stack for each level."""
    stacks = [_Treehash(h, leaves) for h in range(height)]
    auth: list[bytes | None] = []
    first = _Treehash(height, leaves)
    first.begin(0)
    seen: dict[int, list] = {h: [] for h in range(height)}
    for h in range(height):  # the first two nodes of each level: where stacks and path begin
        for k in (0, 1):
            grow = _Treehash(h, leaves)
            grow.begin(k << h)
            while not grow.done:
                grow.step()
            seen[h].append(grow.take())
    for h in range(height):
        auth.append(seen[h][1])
        stacks[h].stack = [(h, seen[h][0])]
    for at in range(len(leaves)):
        yield ["S" if a is None else ("L" if at >> h & 1 else "R") + a.decode() for h, a in enumerate(auth)]
        for h in range(height):
            if (at + 1) % (1 << h) == 0:
                auth[h] = stacks[h].take()
                stacks[h].begin((at + 1 + (1 << h)) ^ (1 << h))
        for _ in range(2 * height - 1):
            goal = min(stacks, key=lambda s: (s.low(), s.level))
            if goal.done:
                break
            goal.step()


# ---------------------------------------------------------------- all blocks


def _places(rows: DataFrame) -> DataFrame:
    """rows, sorted by tree and written, with at, their place in their tree from 0."""
    numbered = rows.select(F.spark_partition_id().alias("_p"), *rows.columns)
    where = numbered.columns.index("tree")

    def ends(batches):
        p, first, last, n_first, n_last = None, None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(where)
            p = batch.column(0)[0].as_py()
            a, b = tree[0].as_py(), tree[len(tree) - 1].as_py()
            if first is None:
                first = a
            n_first += int(pc.sum(pc.equal(tree, first)).as_py())
            n_last = (n_last if b == last else 0) + int(pc.sum(pc.equal(tree, b)).as_py())
            last = b
        if p is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((p, pa.int32()), (first, pa.string()), (last, pa.string()), (n_first, pa.int64()), (n_last, pa.int64()))], ["p", "first", "last", "n_first", "n_last"])

    # a row for each partition
    before, run, tree = {}, 0, None
    for r in sorted(numbered.mapInArrow(ends, "p int, first string, last string, n_first long, n_last long").collect(), key=lambda r: r.p):
        before[r.p] = run if r["first"] == tree else 0
        run, tree = (before[r.p] if r["first"] == r["last"] else 0) + r.n_last, r["last"]

    def place(batches):
        tree, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if tree is None:
                tree, n = batch.column(where)[0].as_py(), before[batch.column(0)[0].as_py()]
            codes = batch.column(where).dictionary_encode()
            names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            at = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
            if names[codes[0]] == tree:
                at[: starts[1] if len(starts) > 1 else None] += n
            tree, n = names[codes[-1]], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(at, pa.int64())], [*batch.schema.names[1:], "at"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return numbered.mapInArrow(place, f"{kinds}, at long")


def _cut(nodes: DataFrame, high: int) -> DataFrame:
    """Nodes with their block, each block in one place, written."""
    return checkpointed(nodes.withColumn("block", F.shiftright("at", high)).repartition("tree", "block"), keep_partitioning=True)


def _sorted_leaves(table: pa.Table, high: int) -> tuple[pa.Table, list[bytes], int]:
    table = table.sort_by("at")
    leaves = [x.encode() for x in table.column("digest").to_pylist()]
    return table, leaves, block_height(table.column("block")[0].as_py(), len(leaves), high)


def _roots(blocks: DataFrame, high: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table, leaves, height = _sorted_leaves(table, high)
        return pa.table({"tree": table.column("tree").slice(0, 1), "at": table.column("block").slice(0, 1), "digest": [block_root(leaves, height).decode()]})

    return blocks.select("tree", "at", "block", "digest").groupBy("tree", "block").applyInArrow(run, "tree string, at long, digest string")


def _climb(nodes: DataFrame, high: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each level, lowest first, and (tree, at = 0, digest) of each tree's root. nodes: (tree, at, digest, ...)."""
    levels = []
    while True:
        levels.append(_cut(nodes, high))
        nodes = checkpointed(_roots(levels[-1], high))
        if not nodes.agg(F.max("at")).first()[0]:
            return levels, nodes


def _descend(blocks: DataFrame, above: DataFrame, high: int) -> DataFrame:
    """blocks with path, subroot and root. above: (tree, at, path, subroot, root) of each block's own root."""
    extra = [c for c in blocks.columns if c not in ("tree", "at", "block", "digest")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table, leaves, height = _sorted_leaves(left, high)
        up, subroot, root = (right.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        n = len(leaves)
        known = {c: table.column(c) for c in ("tree", "at", "digest", *extra)}
        return pa.table(known | {"path": pa.array([p + up for p in paths(leaves, height)], pa.list_(pa.string())), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string())})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select("tree", "at", "digest", *extra).schema)
    upper = above.select(F.col("tree"), F.col("at").alias("block"), "path", "subroot", "root")
    return blocks.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(run, f"{kinds}, path array<string>, subroot string, root string")


def merkle_paths(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """leaves, (tree string, key, digest, ...), with at, path, subroot and root: trees of their leaves by key and digest, and one tree of their roots."""
    spark = leaves.sparkSession
    tune(spark)
    written = checkpointed(leaves).withColumn("_n", F.monotonically_increasing_id())  # tells equal rows apart, so that a range can end between them
    rows = _places(checkpointed(written.orderBy("tree", F.col("key").asc_nulls_first(), "digest", "_n").drop("_n")))
    levels, subroots = _climb(rows, height)
    trees = checkpointed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest").orderBy("own"))
    tops, root = _climb(_places(trees), height)
    above = root.select("tree", "at", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for blocks in reversed(tops):
        above = _descend(blocks, above, height)
    above = above.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root")
    for blocks in reversed(levels):
        above = _descend(blocks, above, height)
    return above


def merkle_manifest(table: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", more: tuple[tuple[str, Column], ...] = (), height: int = HEIGHT) -> DataFrame:
    """(tree, key, digest, at, path, subroot, root) of every row; more: named columns that stay with the rows. tree: "" for a null group, else "=" and the group."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return merkle_paths(table.select(tree.alias("tree"), F.col(key).alias("key"), leaf_of(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(name) for name, c in more]), height)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str, height: int = HEIGHT) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string"))
    seen = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), tampered, F.col("text"))
    found = merkle_manifest(docs, FIELDS, "lang", "doc_id", (("seen", seen),), height)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), ""), 256)
    out = found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", f"({n})::VARCHAR", "text")) + ")"
#: Levels of the trees of a table of (tree, pos, digest, n), and each leaf's path as strings.
_TREES = """{0}_nodes(tree, level, pos, digest, n) AS (SELECT tree, 0, pos, digest, n FROM {0} UNION ALL
SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM {0}_nodes WHERE n > 1 GROUP BY tree, level, pos // 2),
{0}_path AS (SELECT l.tree, l.pos, list(CASE WHEN s.digest IS NULL THEN 'S' WHEN (l.pos >> k.level) & 1 = 1 THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY k.level) AS path
FROM {0} l JOIN (SELECT DISTINCT tree, level FROM {0}_nodes WHERE n > 1) k ON k.tree = l.tree LEFT JOIN {0}_nodes s ON s.tree = l.tree AND s.level = k.level AND s.pos = xor(l.pos >> k.level, 1) GROUP BY l.tree, l.pos),
{0}_root AS (SELECT tree, digest FROM {0}_nodes WHERE n = 1)"""
OP11_SQL = f"""WITH RECURSIVE crcs AS (SELECT DISTINCT doc_id AS known, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
lambda a, c: list_reduce(list_prepend(xor(a, c), list_transform(range(8), lambda z: 0::BIGINT)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM documents WHERE doc_id IS NOT NULL),
rows_ AS (SELECT d.doc_id, coalesce('=' || lang, '') AS tree, {_LEAF("n_chars")} AS digest, {_LEAF("n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END")} AS seen0, crc FROM documents d LEFT JOIN crcs c ON c.known = d.doc_id),
leaves AS (SELECT doc_id, tree, digest, coalesce(CASE WHEN crc IS NOT NULL THEN seen0 END, digest) AS seen, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
{_TREES.format("leaves")},
tops AS (SELECT '' AS tree, tree AS own, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM leaves_root),
{_TREES.format("tops")},
whole AS (SELECT l.doc_id, l.digest AS leaf, l.seen, t.digest AS subroot, r.digest AS root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path FROM leaves l JOIN tops t ON t.own = l.tree JOIN tops_root r ON r.tree = t.tree LEFT JOIN leaves_path p ON p.tree = l.tree AND p.pos = l.pos LEFT JOIN tops_path q ON q.pos = t.pos),
folded AS (SELECT *, list_reduce(list_prepend(seen, path), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_prepend('', list_transform(path, lambda s: s[2:])), lambda a, s: a || s), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
