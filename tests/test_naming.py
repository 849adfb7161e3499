"""Unique names against the rule applied file by file."""

import random

import pytest

from speechlake.operators import naming


def plain(paths, there=()):
    taken, out = set(there), []
    for p in paths:
        base = p.rsplit("/", 1)[-1]
        dot = base.rfind(".")
        stem, ext = (base, "") if dot <= 0 else (base[:dot], base[dot:])
        name, k = base, 0
        while name in taken:
            k += 1
            name = f"{stem}_{k:04d}{ext}"
        taken.add(name)
        out.append(name)
    return out


def same(spark, paths, there=()):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k long, audio_filepath string").repartition(3)
    existing = spark.createDataFrame([(x,) for x in there], "name string") if there else None
    got = {r.k: r.packed_name for r in naming.unique_names(rows, "audio_filepath", "k", existing=existing).collect()}
    assert [got[k] for k in range(len(paths))] == plain(paths, there)
    spark.catalog.clearCache()


def test_the_case_that_used_to_repeat_a_name(spark):
    same(spark, ["a/x.wav", "b/x.wav", "c/x_0001.wav", "d/x_0001.wav", "e/x_0001_0001.wav"])


@pytest.mark.parametrize("seed", range(4))
def test_random_folders(spark, seed):
    rng = random.Random(seed)
    stems = ["x", "x_0001", "x_0002", "x_0003", "x_0001_0001", "x_0002_0001", "x_001", "x_00001", "x_0000", "y"]
    weights = [8, 2, 2, 1, 2, 1, 1, 1, 1, 2]
    paths = [f"{rng.choice('abc')}/{s}{rng.choice(['.wav', '.wav', '.mp3', ''])}" for s in rng.choices(stems, weights, k=80)]
    there = [f"{s}.wav" for s in rng.sample(stems, 4)] if seed % 2 else []
    same(spark, paths, there)


def test_no_clash_at_all(spark):
    same(spark, ["a/x.wav", "a/y.wav", "b/z"])


def test_query_over_the_whole_table(spark):
    from speechlake import file_queries

    d = "/root/testdata/sf0.001"
    paths = [r.audio_filepath for r in file_queries.clashing_paths(spark, d).orderBy("utt_id").collect()]
    got = [r.packed_name for r in file_queries.pack_clashing_names(spark, d).orderBy("utt_id").collect()]
    assert got == plain(paths, ["clip1.wav", "clip2_0001.wav", "clip3_0009.wav"]) and len(set(got)) == len(got)
    spark.catalog.clearCache()


def test_numbers_of_five_digits_stay_whole(spark):
    from speechlake.operators import naming

    rows = spark.range(10_005).selectExpr("id", "concat('d/', id, '/x.wav') AS path")
    got = {r.id: r.packed_name for r in naming.unique_names(rows, "path", "id").collect()}
    assert len(set(got.values())) == 10_005 and got[0] == "x.wav" and got[9999] == "x_9999.wav" and got[10_004] == "x_10004.wav"
