"""Shards read in ranges of record batches: streams and files, dictionaries, columns, splits, broken ones."""

import pyarrow as pa
import pytest

from speechlake.session import ship_code
from speechlake.sources import arrow_shards as S


def write(path, table, rows=10, form="stream"):
    path.parent.mkdir(parents=True, exist_ok=True)
    opener = pa.ipc.new_stream if form == "stream" else pa.ipc.new_file
    with opener(str(path), table.schema) as out:
        for b in table.to_batches(max_chunksize=rows):
            out.write_batch(b)


def table(a, z, words=False):
    text = pa.array([f"t{k % 7}" for k in range(a, z)])
    return pa.table({"k": pa.array(range(a, z), pa.int64()), "text": text.dictionary_encode() if words else text, "audio": [{"path": f"{k}.wav", "bytes": b"x" * 50} for k in range(a, z)]})


@pytest.fixture
def folder(spark, tmp_path):
    write(tmp_path / "train" / "a.arrow", table(0, 200))
    write(tmp_path / "train" / "b.arrow", table(200, 300), form="file")
    write(tmp_path / "dev" / "c.arrow", table(300, 350))
    write(tmp_path / "other" / "d.arrow", table(350, 360).drop(["text"]))
    ship_code(spark)
    spark.dataSource.register(S.ArrowShards)
    return str(tmp_path)


def test_every_row_once_in_many_partitions(spark, folder):
    df = spark.read.format("arrow_shards").option("rangeBytes", 1000).load(folder)
    assert df.columns == ["k", "text", "audio", "split"] and df.rdd.getNumPartitions() > 20
    rows = df.collect()
    assert sorted(r.k for r in rows) == list(range(360))
    assert all(r.text == (f"t{r.k % 7}" if r.k < 350 else None) and r.audio.path == f"{r.k}.wav" for r in rows)
    assert {r.split for r in rows if r.k >= 350} == {None} and {r.split for r in rows if r.k < 300} == {"train"}


def test_columns_and_splits(spark, folder):
    df = spark.read.format("arrow_shards").option("columns", "text,k").option("split", "validation").load(folder)
    assert df.columns == ["text", "k", "split"] and sorted(r.k for r in df.collect()) == list(range(300, 350))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        own = spark.read.format("arrow_shards").option("columns", "k").option("pushFilters", True).load(folder).where("split = 'validation' AND k < 305")
        assert own.rdd.getNumPartitions() == 1 and sorted(r.k for r in own.collect()) == list(range(300, 305))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_dictionaries_reach_every_range(tmp_path):
    write(tmp_path / "d.arrow", table(0, 100, words=True))
    parts = S.ranges(str(tmp_path / "d.arrow"), 1)
    assert len(parts) == 10
    for k, p in enumerate(parts):
        (batch,) = S.read_range(str(tmp_path / "d.arrow"), p)
        assert batch.column("text").to_pylist() == [f"t{x % 7}" for x in range(10 * k, 10 * k + 10)]


def test_only_headers_are_read_to_cut_a_shard(tmp_path):
    write(tmp_path / "a.arrow", pa.table({"x": [b"y" * 100_000] * 50}), rows=1)

    class Counting:
        def __init__(self, file):
            self.file, self.seen = file, 0

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            self.seen += n
            return self.file.read_at(n, at)

    with pa.OSFile(str(tmp_path / "a.arrow")) as f:
        counting = Counting(f)
        assert sum(kind == 3 for kind, _, _ in S.messages(counting)) == 50 and counting.seen < 50_000


def test_broken_and_empty(spark, tmp_path):
    write(tmp_path / "a.arrow", table(0, 50))
    raw = (tmp_path / "a.arrow").read_bytes()
    (tmp_path / "a.arrow").write_bytes(raw[: len(raw) - 300])
    with pytest.raises(ValueError, match="broken shard"):
        S.ranges(str(tmp_path / "a.arrow"), 1000)
    spark.dataSource.register(S.ArrowShards)
    (tmp_path / "none").mkdir()
    assert spark.read.format("arrow_shards").load(str(tmp_path / "none")).columns == ["split"]
    assert spark.read.format("arrow_shards").load(str(tmp_path / "none")).collect() == []
