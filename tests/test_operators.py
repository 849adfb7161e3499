"""Operators on small tables: rules that the twins at scale don't show."""

import pytest
from pyspark.sql import functions as F

from speechlake.operators import errors, inference, manifests, mixing, ranking, selection
from speechlake.plans import workloads


def test_mix_plan():
    assert mixing.mix_plan({"a": 0.5, "b": 0.5}, 5) == {"a": 3, "b": 2}
    for target in range(0, 120, 7):
        plan = mixing.mix_plan(mixing.STAGE1, target)
        assert sum(plan.values()) == target and min(plan.values()) >= 0
    with pytest.raises(ValueError):
        mixing.normalize_ratios({"a": 0.0})
    assert mixing.parse_ratios(["a=1", "b=3"]) == {"a": 0.25, "b": 0.75}
    assert sum(mixing.stage1_ratios(["golos", "cv"]).values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        mixing.stage1_ratios(["golos", "other"])


def test_short_sources_give_what_they_have(spark):
    rows = spark.createDataFrame([("a", k) for k in range(3)] + [("b", k) for k in range(50)], "source string, k int")
    got = {r["source"]: r["count"] for r in mixing.ratio_mix(rows, "source", {"a": 0.5, "b": 0.5}, 20, "k").groupBy("source").count().collect()}
    assert got == {"a": 3, "b": 10}


def test_splits_are_disjoint_and_whole(spark):
    rows = spark.createDataFrame([(k, "g" if k < 70 else "h") for k in range(71)], "k int, g string")
    got = mixing.stratified_split(rows, "g", 0.1, "k").collect()
    assert sorted(r.k for r in got) == list(range(71))
    assert sum(r.split == "val" for r in got if r.g == "g") == 7 and sum(r.split == "val" for r in got if r.g == "h") == 0
    assert sum(r.split == "val" for r in mixing.random_split(rows, 0.5, "k").collect()) == 36


def test_row_numbers_hold_over_partitions(spark):
    rows = spark.createDataFrame([(k, k % 3 if k % 4 else None) for k in range(200)], "k int, g int").repartition(9)
    assert {r.k: r.rn for r in ranking.row_numbers(rows, [F.desc("k")]).collect()} == {k: 200 - k for k in range(200)}
    got = ranking.group_row_numbers(rows, ["g"], [F.col("k").asc()]).collect()
    for g in (None, 0, 1, 2):
        own = sorted(r.k for r in got if r.g == g)
        assert {r.k: (r.rn, r.n_group) for r in got if r.g == g} == {k: (n, len(own)) for n, k in enumerate(own, 1)}
    sums = ranking.running_sums(rows, [F.col("k").asc()], F.col("k").cast("double")).collect()
    assert all(r.before == r.k * (r.k - 1) / 2 for r in sums)


def test_large_and_small_groups_are_ranked_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else (None if k % 2 else f"g{k % 7}")) for k in range(300)], "k int, g string").repartition(7)
    want = sorted(ranking.group_row_numbers(rows, ["g"], [F.col("k").asc()]).collect(), key=lambda r: r.k)
    assert [r.k for r in want] == list(range(300)) and {r.n_group for r in want if r.g == "hot"} == {200}
    monkeypatch.setattr(ranking, "LARGEST", 2)
    assert sorted(ranking.group_row_numbers(rows, ["g"], [F.col("k").asc()]).collect(), key=lambda r: r.k) == want


def test_speaker_cap_over_partitions(spark):
    data = [(k, ("s" if k % 3 else None) if k % 5 else f"t{k % 2}", float(k % 4) if k % 11 else None) for k in range(400)]
    rows = spark.createDataFrame(data, "k int, speaker string, duration double").repartition(9)
    want, time = set(), {}
    for k, s, d in data:
        time[s] = time.get(s, 0.0) + (d or 0.0)
        if time[s] <= 60:
            want.add(k)
    got = selection.speaker_cap(rows, "speaker", 60, [F.col("k").asc()])
    assert got.columns == rows.columns and {r.k for r in got.collect()} == want
    assert selection.speaker_cap(rows.where("k < 0"), "speaker", 60, [F.col("k").asc()]).count() == 0
    sums = {r.k: r.before for r in ranking.group_running_sums(rows, ["speaker"], [F.col("k").asc()], F.lit(1.0)).collect()}
    seen = {}
    for k, s, _ in data:
        assert sums[k] == seen.get(s, 0)
        seen[s] = seen.get(s, 0) + 1


def test_hours_budget_takes_the_crossing_segment(spark):
    rows = spark.createDataFrame([(1, 0.9, 10.0), (2, 0.8, 10.0), (3, 0.7, 10.0), (4, 0.95, None)], "utt_id int, wer double, duration double")
    assert {r.utt_id for r in selection.hours_budget(rows, 15 / 3600).collect()} == {1, 2, 4}


def test_quantiles(spark):
    rows = spark.createDataFrame([(k, "m", 0.5, 0.1, None) for k in range(5)], "utt_id int, model_id string, wer double, cer double, sim double")
    assert [r.utt_id for r in selection.hardest(rows, 0.25).orderBy("utt_id").collect()] == [0, 1]
    assert selection.hardest(rows, 7.0).count() == 5 and selection.hardest(rows, -1.0).count() == 0


def test_leaderboard_counts_null_as_zero(spark):
    rows = spark.createDataFrame([("m", 0.0, 0.0, 0.0, 1.0), ("m", 0.0, 0.0, 0.0, None)], "model_id string, wer double, cer double, ser double, sim double")
    assert errors.leaderboard(rows).head().sim == 0.5 and errors.leaderboard(rows, null_aware=True).head().sim == 1.0
    assert errors.baseline_deltas(errors.leaderboard(rows.withColumn("sim", F.lit(0.0)))).head().baseline_cosine == 1.0


def test_pack_names_come_one_after_another(spark):
    rows = spark.createDataFrame(list(enumerate(["a/x.wav", "b/x.wav", "c/x.wav", "d/x_0001.wav"])), "k int, audio_filepath string")
    got = [r.packed_name for r in manifests.pack_rename(rows, "k").orderBy("k").collect()]
    assert got == ["x.wav", "x_0001.wav", "x_0002.wav", "x_0001_0001.wav"]  # the second x came before the file that is named so


def test_durations_and_texts(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "y", 3.0), ("c", "  ", 99.0), (None, "z", 3.0)], "audio_filepath string, text string, duration double")
    assert manifests.duration_filter(rows, 1, 5).count() == 3 and manifests.duration_filter(rows, 1, 5, null_passes=False).count() == 2
    assert manifests.drop_empty(rows).count() == 2
    assert tuple(manifests.build_counters(rows, 1, 5).head()) == (3, 1, 0)
    assert manifests.map_custom(rows, "audio_filepath", "nothing").count() == 0
    assert manifests.map_custom(rows, "audio_filepath", "duration").where("text = ''").count() == 1


def test_windows_of_long_audio(spark):
    rows = spark.createDataFrame([("a", 30.0), ("b", 14.0), ("c", 0.0)], "k string, duration double")
    got = [(r.k, r.start) for r in manifests.sliding_chunks(rows).orderBy("k", "idx").collect()]
    assert got == [("a", 0.0), ("a", 14.0), ("a", 28.0), ("b", 0.0)]
    parts = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("a", 2, "")], "k string, idx int, text string")
    assert manifests.join_chunks(parts, "k").head().text == "one two"


def test_names_and_ids(spark):
    one = spark.createDataFrame([("bond005___x",), ("a/b___c",)], "x string").select(manifests.normalize_repo_id(F.col("x")))
    assert [r[0] for r in one.collect()] == ["bond005/x", "a/b___c"]
    rows = spark.createDataFrame([("", "p", "q")], "audio_filepath string, audio string, id string")
    assert rows.select(manifests.manifest_key(rows)).head()[0] == "p" and rows.select(manifests.manifest_key(rows, analyzer=True)).head()[0] == "q"
    assert manifests.choose_mapper("mozilla/common_voice_17") is manifests.map_common_voice and manifests.choose_mapper("x") is manifests.map_generic
    assert manifests.detect_columns(rows) == ("audio", None)


def test_models_are_plugged_in(spark):
    audio = spark.createDataFrame([(str(k), f"clip {k}") for k in range(7)], "audio_filepath string, content string")

    def load():
        def short(batch):
            if len(batch) > 2:
                raise RuntimeError("too long")
            return [x.upper() for x in batch]

        return inference.with_fallback(short, lambda batch: [x[::-1] for x in batch])

    got = {r.audio_filepath: r.hyp for r in inference.recognize_speech(audio.coalesce(1), load, size=4).collect()}
    assert got["0"] == "0 pilc" and len(got) == 7
    assert inference.batch_size("whisper-large-v3") == 24 and inference.batch_size("other") == 16


def test_stage1_needs_a_ratio_for_every_source(spark):
    m = spark.createDataFrame([("a", "x", 2.0)], "audio_filepath string, text string, duration double")
    p = spark.createDataFrame([("a", "x")], "audio_filepath string, pred_text string")
    with pytest.raises(ValueError):
        workloads.stage1_mix({"golos": m, "cv": m}, p, 10, ratios={"golos": 1.0})
    assert workloads.stage1_mix({"golos": m}, p, 10).count() == 1


def test_no_common_keys_is_an_error(spark):
    refs = spark.createDataFrame([("a", "x")], "utt_id string, ref string")
    preds = spark.createDataFrame([("m", "b", "x")], "model_id string, utt_id string, hyp string")
    with pytest.raises(ValueError):
        workloads.score_corpus(refs, preds)
    with pytest.raises(ValueError):
        workloads.analyze_errors(refs, preds, ["m"], sample=3)


def test_error_analysis_end_to_end(spark):
    refs = spark.createDataFrame([("a", "one two three"), ("b", "four")], "utt_id string, ref string")
    preds = spark.createDataFrame([("m", "a", "one too three"), ("n", "a", "one two three"), ("n", "b", "for")], "model_id string, utt_id string, hyp string")
    run = workloads.analyze_errors(refs, preds, ["m", "n"])
    assert [(r.model_id, r.wer) for r in run.models.collect()] == [("n", 0.5), ("m", 0.666667)]
    assert {(r.ref, r.hyp) for r in run.confusions.collect()} == {("two", "too"), ("four", "for")}
    assert {(r.model_a, r.model_b): r.n_both for r in run.overlap.collect()} == {("m", "m"): 2, ("m", "n"): 1, ("n", "m"): 1, ("n", "n"): 1}
    assert run.totals.head().ops_del == 1


def test_pairs_bring_every_model(spark):
    refs = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (2, "b again", 9), (3, "c", 1), (None, "d", 2)], "utt_id long, ref string, n int")
    preds = spark.createDataFrame([("x", 1, "x1", 0.5), ("y", 1, None, 0.25), ("y", 2, "y2", 1.0), ("y", 2, "y2 too", 2.0), ("w", 3, "other", 3.0), ("x", None, "no key", 4.0)], "model_id string, utt_id long, hyp string, p double")
    found = errors.pair_with_models(refs, preds, ["z", "y", "x"])
    assert found.columns == ["model_id", "utt_id", "ref", "n", "hyp", "p"]
    want = [("x", 1, "a", 7, "x1", 0.5), ("y", 1, "a", 7, "", 0.25), ("z", 1, "a", 7, "", None)]
    for ref, n in (("b", 8), ("b again", 9)):
        want += [("x", 2, ref, n, "", None), ("y", 2, ref, n, "y2", 1.0), ("y", 2, ref, n, "y2 too", 2.0), ("z", 2, ref, n, "", None)]
    want += [(m, k, ref, n, "", None) for k, ref, n in ((3, "c", 1), (None, "d", 2)) for m in "xyz"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert errors.pair_with_models(refs, preds, []).count() == 0
    assert errors.pair_with_models(refs, preds).count() == 5 * 3 + 2


def test_pairs_shuffle_a_reference_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        refs = spark.range(50).selectExpr("id AS utt_id", "'a' AS ref")
        preds = refs.selectExpr("explode(array('x', 'y')) AS model_id", "utt_id", "ref AS hyp")
        plan = errors.pair_with_models(refs, preds, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(utt_id") == 2 and "hashpartitioning(model_id" not in plan
