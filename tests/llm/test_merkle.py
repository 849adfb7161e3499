"""Merkle paths against trees built level by level; odd rows; tampering shows."""

import hashlib

import duckdb
import pytest

from speechlake.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """(root, path of each leaf), level by level."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    found = []
    for k in range(len(leaves)):
        path = []
        for level, nodes in enumerate(levels[:-1]):
            s = (k >> level) ^ 1
            path.append("S" if s >= len(nodes) else ("L" if s < (k >> level) else "R") + nodes[s])
        found.append(path)
    return levels[-1][0], found


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 9, 31, 32, 33, 100, 128])
def test_a_block_walks_like_a_whole_tree(n):
    leaves = [h(str(k)) for k in range(n)]
    coded = [x.encode() for x in leaves]
    root, want = tree(leaves)
    height = merkle.block_height(0, n, 7)
    assert merkle.block_root(coded, height).decode() == root
    assert list(merkle.paths(coded, height)) == want


def test_stacks_stay_small():
    leaves = [h(str(k)).encode() for k in range(256)]
    most = 0
    real = merkle._Treehash.step

    def step(self):
        nonlocal most
        real(self)
        most = max(most, len(self.stack))

    merkle._Treehash.step = step
    try:
        list(merkle.paths(leaves, 8))
    finally:
        merkle._Treehash.step = real
    assert most <= 9


DOCS = [(k, f"text {k}", "en" if k % 3 else "de", "s", k) for k in range(300)]
DOCS += [(None, None, None, None, None), (None, "x", "en", None, 9), (7, "text 7", "en", "s", 7), (7, "text 7", "en", "s", 7), (7, "", "en", "s", 0), (301, "é" * 50_000, "", "", 2**63 - 1), (302, "", "zz", "s", 0)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("height", [2, 3, 10])
def test_many_blocks_equal_the_sql(spark, tmp_path, height):
    rows = [r for r in DOCS if r[0] != 301]  # its count plus one is beyond SQL's longs
    spark.createDataFrame(rows, KIND).selectExpr("*", "1 as tree", "'q' as path", "2 as at").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path), height)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(merkle.OP11_SQL)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in got.collect())


def test_paths_lead_to_the_root_and_tampering_shows(spark, tmp_path):
    spark.createDataFrame(DOCS, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    rows = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(rows) == len(DOCS) and len({r.root for r in rows}) == 1
    import zlib

    for r in rows:
        altered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified == (not altered) and (r.folded_root == r.root) == r.verified
    one = next(r for r in rows if r.doc_id == 3)
    assert one.leaf == h("1:31:s2:de1:36:text 3")
    empty = spark.createDataFrame([], KIND)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op11_merkle_manifest(spark, f"{tmp_path}/none").collect() == []


def test_one_row_is_its_own_root(spark):
    (r,) = merkle.merkle_manifest(spark.createDataFrame([(1, "a", "en", None, 1)], KIND)).collect()
    assert r.path == [] and r.digest == r.subroot == r.root
