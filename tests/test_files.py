"""Reading and writing files."""

import json
import wave

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechlake.operators import inference
from speechlake.sources import readers, writers

BOM = "﻿"


def test_jsonl_strict_and_lenient(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text(BOM + '{"audio_filepath": "a", "text": "x"}\n\n{"audio": "b", "text": null}\nnot json\n{"audio_filepath": "a", "text": "y"}\n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(p), strict=False)
    assert rows.count() == 3
    with pytest.raises(Exception, match="malformed line"):
        readers.read_jsonl(spark, str(p)).collect()
    assert {r.utt_id: r.text for r in readers.read_key_map(spark, str(p)).collect()} == {"a": "y", "b": None}


def test_references_of_each_form(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"audio": "a", "text": "x"}\n{"audio_filepath": "", "audio": "a", "text": "z"}\n{"audio": "b", "text": null}\n')
    (tmp_path / "r.json").write_text(BOM + json.dumps({"a": "z", "b": ""}), encoding="utf-8")
    (tmp_path / "l.json").write_text(json.dumps([{"audio_filepath": "a", "text": "z"}, {"audio": "b", "text": ""}, {"text": "none"}], indent=1))
    for name in ("r.jsonl", "r.json", "l.json"):
        assert {r.utt_id: r.text for r in readers.read_references(spark, str(tmp_path / name)).collect()} == {"a": "z", "b": ""}
    (tmp_path / "mixed.json").write_text(json.dumps({"a": "z", "n": 3}))
    assert [r.utt_id for r in readers.read_json_map(spark, str(tmp_path / "mixed.json"), strings_only=True).collect()] == ["a"]
    preds = readers.read_predictions(spark, {"m": str(tmp_path / "r.json")})
    assert preds.count() == 2 and preds.columns == ["model_id", "utt_id", "hyp"]
    with pytest.raises(ValueError):
        readers.read_predictions(spark, {})
    assert readers.parse_inputs(["m=x/y.json", "x/z.jsonl"]) == {"m": "x/y.json", "z": "x/z.jsonl"}


def test_scores_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text("utt_id,model_id,wer,cer,sim\na, m ,0.5,,None\nb,m,bad,0.1,\nc,n,0.1,0.1,0.2\n")
    got = readers.read_scores(spark, str(tmp_path / "s.csv"), "m").collect()
    assert [(r.utt_id, r.wer, r.cer, r.sim) for r in got] == [("a", 0.5, 0.0, None)]


def test_missing_split_is_an_error(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "train.parquet"))
    assert readers.read_splits(spark, str(tmp_path), "train").count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_splits(spark, str(tmp_path), "train+test")


def test_arrow_shards(spark, tmp_path):
    for folder, paths in (("train-0", ["a.wav", None]), ("dev", ["b.wav"]), ("other", ["c.wav"])):  # the test's own folder names a split too
        (tmp_path / folder).mkdir()
        table = pa.table({"audio": [{"path": p} for p in paths], "sentence": [" x "] * len(paths)})
        with pa.OSFile(str(tmp_path / folder / "x.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table)
    got = {(r.split, r.audio_filepath, r.text) for r in readers.read_arrow_shards(spark, str(tmp_path)).collect()}
    assert got == {("train", "a.wav", "x"), ("validation", "b.wav", "x"), ("test", "c.wav", "x")}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "ж")], "audio_filepath string, text string")
    assert writers.write_jsonl(rows.coalesce(1), str(tmp_path / "o.jsonl")) == 2
    lines = sorted("".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o.jsonl").glob("part-*")).splitlines())
    assert lines == ['{"audio_filepath":"a","text":null}', '{"audio_filepath":"b","text":"ж"}']
    assert writers.write_csv(rows, str(tmp_path / "o.csv")) and not writers.write_csv(rows.limit(0), str(tmp_path / "none.csv")) and not (tmp_path / "none.csv").exists()
    preds = spark.createDataFrame([("b", "2"), ("a", "1")], "utt_id string, hyp string")
    writers.write_predictions(preds, str(tmp_path / "p.json"))
    assert {r.utt_id: r.hyp for r in readers.read_json_map(spark, str(tmp_path / "p.json"), "utt_id", "hyp").collect()} == {"a": "1", "b": "2"}
    page = writers.html_report(spark.createDataFrame([("<b>",)], "model string"), rows, rows.limit(0))
    assert "&lt;b&gt;" in page and "<b>" not in page and "no rows" in page
    assert "wer=0.5000" in writers.console(spark.createDataFrame([("m", 0.5)], "model string, wer double"))
    assert spark.range(1).select(writers.relative_path(F.lit("d\\e/x.wav"), "d")).head()[0] == "e/x.wav"


def test_audio_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, [0.0] * 8000, "x"), (1, None, "gone"), (2, [0.1] * 16000, "y")], "ord int, array array<float>, text string")
    got = {r.audio_filepath.rsplit("/", 1)[1]: r.duration for r in writers.dump_wavs(rows, str(tmp_path / "w")).collect()}
    assert got == {"utt_000000.wav": 0.5, "utt_000002.wav": 1.0}
    (tmp_path / "w" / "broken.wav").write_bytes(b"no")
    found = inference.with_durations(readers.read_audio(spark, str(tmp_path / "w")))
    assert [r.duration for r in found.orderBy("audio_filepath").collect()] == [None, 0.5, 1.0]
    with wave.open(str(tmp_path / "w" / "utt_000000.wav")) as w:
        assert w.getframerate() == 16_000


def test_open_fields(spark):
    rows = spark.createDataFrame([("a", 1)], "audio_filepath string, snr int")
    assert rows.select(readers.open_fields(rows, ["audio_filepath"]).cast("string")).head()[0] == '{"snr":1}'


def test_stream(spark, tmp_path):
    from speechlake.streaming.scoring import score_stream

    refs = spark.createDataFrame([("a", "one two")], "utt_id string, ref string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"model_id":"m","utt_id":"a","hyp":"one"}\n')
    live = spark.readStream.schema("model_id string, utt_id string, hyp string").json(str(tmp_path / "in"))
    q = score_stream(live, refs).select("utt_id", "wer").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.utt_id, r.wer) for r in spark.table("scored").collect()] == [("a", 0.5)]


def test_written_rows_are_counted_as_they_go_out(spark, tmp_path):
    from speechlake.sources import writers

    rows = spark.range(57).repartition(5)
    assert writers.write_jsonl(rows, str(tmp_path / "a")) == 57
    assert writers.write_jsonl(rows.where("id < 0"), str(tmp_path / "b")) == 0
    assert writers.write_jsonl(spark.createDataFrame([], "id long").where("false"), str(tmp_path / "c")) == 0
    assert writers.write_jsonl(rows.orderBy("id").limit(3), str(tmp_path / "d"), "gzip") == 3
