"""Plugged models, long recordings, and files in folders."""

import io
import json
import wave

import numpy as np

from speechlake.functions import vectors
from speechlake.operators import errors, inference, manifests
from speechlake.sources import readers


def wav(samples, rate=100, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((channels, 2, rate, 0, "NONE", ""))
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_later_files_win_whatever_their_size(spark, tmp_path):
    for k, n in enumerate((1, 400, 20, 5000, 3)):
        lines = [json.dumps({"audio": "a", "text": f"{k}"})] + [json.dumps({"audio": f"{k}-{j}", "text": "x" * 50}) for j in range(n)]
        (tmp_path / f"part-{k:05}.jsonl").write_text("\n".join(lines))
    rows = readers.read_key_map(spark, str(tmp_path)).collect()
    assert {r.utt_id: r.text for r in rows}["a"] == "4" and len(rows) == 1 + 1 + 400 + 20 + 5000 + 3


def test_lines_of_one_file_keep_their_order(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"audio": "a", "text": str(k)}) for k in range(3000)))
    assert [r.text for r in readers.read_jsonl(spark, str(tmp_path / "m.jsonl")).orderBy("line_no").collect()] == [str(k) for k in range(3000)]


def test_audio_that_lists_name(spark, tmp_path):
    a, b = tmp_path / "a.wav", tmp_path / "b.wav"
    a.write_bytes(wav([1, 2]))
    b.write_bytes(wav([3]))
    (tmp_path / "l.jsonl").write_text(json.dumps({"audio_filepath": str(a)}) + "\n" + json.dumps({"audio": f"file://{b}"}) + "\n" + json.dumps({"text": "none"}))
    (tmp_path / "m.json").write_text(json.dumps({str(a): "", str(tmp_path / "missing.wav"): ""}))
    (tmp_path / "n.json").write_text(json.dumps([{"audio": str(b)}, {"audio_filepath": str(a)}]))
    read = lambda name: {r.audio_filepath.rsplit("/", 1)[-1]: r.content for r in readers.read_audio(spark, str(tmp_path / name)).collect()}
    assert read("l.jsonl") == read("n.json") == read("") == {"a.wav": wav([1, 2]), "b.wav": wav([3])}
    assert read("m.json") == {"a.wav": wav([1, 2]), "missing.wav": None}
    assert read("a.wav") == {"a.wav": wav([1, 2])}


def test_long_recordings_in_windows(spark):
    stereo = np.stack([np.arange(0, 3500), np.arange(0, 3500) + 2], axis=1)  # 35 seconds; the mean is k + 1
    clips = list(inference.wav_windows(wav(stereo, channels=2)))
    assert len(clips) == 3 and [inference.wav_seconds(c) for c in clips] == [15.0, 15.0, 7.0]
    with wave.open(io.BytesIO(clips[1])) as w:
        assert w.getnchannels() == 1 and np.frombuffer(w.readframes(2), "<i2").tolist() == [1401, 1402]

    def load():
        def model(batch):
            out = []
            for x in batch:
                with wave.open(io.BytesIO(x)) as w:
                    out.append("s" + str(int(np.frombuffer(w.readframes(1), "<i2")[0])))
            return out

        return model

    rows = spark.createDataFrame([("long", wav(stereo, channels=2)), ("short", wav([7])), ("bad", b"x"), ("none", None), ("silent", wav([]))], "audio_filepath string, content binary")
    found = {r.audio_filepath: r.hyp for r in inference.recognize_long(rows, load).collect()}
    assert found == {"long": "s1 s1401 s2801", "short": "s7", "bad": "", "none": "", "silent": ""}


def test_models_get_each_rows_arguments(spark):
    rows = manifests.attach_constants(spark.createDataFrame([("a", "x"), ("b", "y")], "audio_filepath string, content string"), "ru", "en", "no")
    load = lambda: lambda batch, given: [f"{c}:{g['source_lang']}>{g['target_lang']}:{g['pnc']}" for c, g in zip(batch, given, strict=True)]
    found = inference.recognize_speech(rows, load, arguments=("source_lang", "target_lang", "pnc")).collect()
    assert {r.audio_filepath: r.hyp for r in found} == {"a": "x:ru>en:no", "b": "y:ru>en:no"}


def test_pair_scores_on_the_leaderboard(spark):
    rows = spark.createDataFrame([("m", "a b", "a b", 0.0), ("m", "a b", "c", 1.0), ("n", "a", None, 1.0)], "model_id string, ref string, hyp string, wer double").selectExpr("*", "wer as cer", "wer as ser", "cast(null as double) as sim")

    def f1(refs, hyps):
        return [2 * len(set(r.split()) & set(h.split())) / max(1, len(r.split()) + len(h.split())) for r, h in zip(refs, hyps, strict=True)]

    def refuses(refs, hyps):
        raise RuntimeError("no")

    board = {r.model_id: r.bert_score for r in errors.leaderboard(vectors.pair_scores(rows, "ref", "hyp", f1)).collect()}
    assert board == {"m": 0.5, "n": 0.0}
    assert {r.bert_score for r in vectors.pair_scores(rows, "ref", "hyp", refuses).collect()} == {None}
    assert {r.bert_score for r in vectors.pair_scores(rows, "ref", "hyp", None).collect()} == {None}
    assert "bert_score" not in errors.leaderboard(rows).columns


def test_text_similarity_encodes_each_text_once(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "l string, r string")
    encode = lambda s: s.map({"a": [1.0, 0.0], "b": [0.0, 2.0]}.get)
    found = [(r.l, r.r, None if r.sim is None else round(r.sim, 6)) for r in vectors.text_similarity(rows, "l", "r", encode).collect()]
    assert sorted(found, key=str) == sorted([("a", "a", 1.0), ("a", "b", 0.0), (None, "a", None)], key=str)


def test_hypothesis_text_and_padding(spark):
    rows = spark.createDataFrame([(None, "p", "t"), ("x", "p", None)], "text string, pred_text string, other string")
    assert [r[0] for r in rows.select(manifests.hypothesis_text(rows)).collect()] == ["p", "x"]
    labels = spark.createDataFrame([([1, 2, 3],), ([4],)], "l array<int>")
    assert [r.l for r in manifests.pad_and_mask(labels, "l", 2).collect()] == [[1, 2], [4, -100]]


def test_resources_of_a_model_stage(spark):
    from speechlake.operators import inference

    assert inference.model_resources(spark) is None
    audio = spark.createDataFrame([("a", bytearray(b"xy")), ("b", None)], "audio_filepath string, content binary")
    texts = inference.recognize_speech(audio, lambda: lambda batch: [str(len(x or b"")) for x in batch], profile=inference.model_resources(spark))
    assert {r.audio_filepath: r.hyp for r in texts.collect()} == {"a": "2", "b": "0"}
    profile = inference.resource_profile(0.5, 2, 8, "6g", "/opt/find.sh")
    assert {k: v.amount for k, v in profile.taskResources.items()} == {"cpus": 2.0, "gpu": 0.5}
    assert profile.executorResources["gpu"].amount == 2 and profile.executorResources["cores"].amount == 8
    assert set(inference.resource_profile(0, 1, None, None, "").taskResources) == {"cpus"}
