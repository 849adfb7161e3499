"""Token files: rows that share a doc_id have one order, and ranges are dealt evenly."""

import random
import zlib

import public_tokenizers
from pyspark.sql import functions as F

from speechlake.llm import token_ids


def test_shared_ids_have_one_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(6), " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(4)))) for _ in range(60)] + [(None, "lost"), (3, None)]
    seen = []
    for run in range(2):
        docs = spark.createDataFrame(random.Random(run).sample(rows, len(rows)), "doc_id long, text string").repartition(3 + run)
        path = f"{tmp_path}/{run}"
        token_ids.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), path)
        seen.append(sorted(token_ids.read_token_files(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 61
    at = 0
    for r in seen[0]:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in seen[0]]
    assert ids == sorted(ids) and zlib.crc32((1).to_bytes(4, "little")) in {r.ids_crc32 for r in seen[0]}


def test_every_range_has_a_task(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
        token_ids.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "x"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = spark.read.parquet(str(tmp_path / "x")).groupBy(F.input_file_name().alias("f")).agg(F.sum("n_tokens").alias("n"), F.count_distinct("part").alias("parts")).collect()
    assert len(files) == 8 and {r.parts for r in files} == {1} and max(r.n for r in files) <= 1.6 * min(r.n for r in files)
