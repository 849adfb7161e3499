"""Every command over small files."""

import json

import pytest

from speechlake.cli import main


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


@pytest.fixture
def files(tmp_path):
    rows = [{"audio_filepath": f"a/{k}.wav", "text": f"one two three {k}", "dataset": "x" if k % 2 else "y", "duration": 2.0 + k} for k in range(20)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "p.json").write_text(json.dumps({r["audio_filepath"]: r["text"] if k % 3 else "one too" for k, r in enumerate(rows)}))
    (tmp_path / "n.jsonl").write_text("\n".join(json.dumps({"audio": f"n/{k}.wav"}) for k in range(9)))
    (tmp_path / "d.json").write_text(json.dumps({r["audio_filepath"]: r["duration"] for r in rows}))
    return tmp_path


def test_commands(spark, files, capsys):
    f = lambda name: str(files / name)
    main(["analyze-errors", f("m.jsonl"), "--pred", f"p={f('p.json')}", "--outdir", f("out")], spark)
    assert json.loads((files / "out" / "summary.json").read_text())["models"][0]["count"] == 20 and (files / "out" / "per_utterance").is_dir()
    main(["evaluate", f("m.jsonl"), f("p.json"), "--werd"], spark)
    assert "werd=" in capsys.readouterr().out
    main(["select-finetune", f("m.jsonl"), f("p.json"), "--hours", "0.004", "--durations", f("d.json"), "--output", f("ft")], spark)
    assert 1 <= len(lines(files / "ft")) < 7
    main(["select-hardest", "--ref", f("m.jsonl"), "--pred", f("p.json"), "--out", f("hard"), "--nonspeech", f("n.jsonl"), "--nonspeech_ratio", "0.5", "--group_key", "dataset"], spark)
    kinds = [r["difficulty"] for r in lines(files / "hard")]
    assert kinds.count("hard") == 6 and kinds.count("easy") == 1 and kinds.count("nospeech") == 4
    main(["mix", "--in", f"a={f('m.jsonl')}", "--in", f"b={f('n.jsonl')}", "--out", f("all")], spark)
    assert len(lines(files / "all")) == 29
    main(["mix", "--in", f"a={f('m.jsonl')}", "--in", f"b={f('n.jsonl')}", "--out", f("some"), "--target_size", "10", "--ratios", "a=0.7,b=0.3"], spark)
    assert sorted((r.get("audio_filepath") or r["audio"])[0] for r in lines(files / "some")) == ["a"] * 7 + ["n"] * 3
    main(["split", "--in", f("m.jsonl"), "--train", f("tr"), "--val", f("va"), "--group_key", "dataset", "--val_ratio", "0.2"], spark)
    assert len(lines(files / "tr")) == 16 and len(lines(files / "va")) == 4
    main(["filter", "--manifest", f("m.jsonl"), "--pred", f("p.json"), "--out", f("kept"), "--max_dur", "10"], spark)
    assert {r["wer"] for r in lines(files / "kept")} == {0.0}
    main(["pack", "--input", f("m.jsonl"), "--out_dir", f("pk")], spark)
    assert len({r["audio_filepath"] for r in lines(files / "pk" / "manifest.jsonl")}) == 20
    main(["cuts", "--manifest", f("m.jsonl"), "--out", f("cuts")], spark)
    assert len(list((files / "cuts").glob("part-*.gz"))) >= 1
    spark.createDataFrame([("x.wav", " hi "), ("y.wav", "")], "path string, sentence string").write.parquet(f("train.parquet"))
    main(["build-manifest", "--data_dir", str(files), "--out", f("built"), "--drop_empty"], spark)
    assert [r["text"] for r in lines(files / "built")] == ["hi"]


def test_rows_keep_their_own_fields(spark, tmp_path):
    rows = [{"audio": f"a/{k % 3}.wav", "text": f"t {k}", "speaker": f"s{k % 2}", "snr": k / 4, "tags": [k, {"x": None}], "note": None} | ({"dataset": "own"} if k % 5 == 0 else {}) for k in range(20)]
    (tmp_path / "m.jsonl").write_text("\ufeff" + "\n".join(json.dumps(r) for r in rows) + "\nbroken\n[1]\n" + json.dumps({"text": "no key"}) + "\n")
    f = lambda name: str(tmp_path / name)
    main(["mix", "--in", f"src={f('m.jsonl')}", "--out", f("mixed")], spark)
    want = [{**r, "dataset": r.get("dataset", "src")} for r in [*rows, {"text": "no key"}]]
    order = lambda xs: sorted(map(lambda x: json.dumps(x, sort_keys=True), xs))
    assert order(lines(tmp_path / "mixed")) == order(want)
    main(["split", "--in", f("m.jsonl"), "--train", f("tr"), "--val", f("va"), "--group_key", "speaker", "--val_ratio", "0.2"], spark)
    parts = lines(tmp_path / "tr"), lines(tmp_path / "va")
    assert order([*parts[0], *parts[1]]) == order([*rows, {"text": "no key"}])
    assert sorted(r["speaker"] for r in parts[1]) == ["s0", "s0", "s1", "s1"]
    (tmp_path / "pk").mkdir()
    (tmp_path / "pk" / "0_0001.wav").write_bytes(b"")
    main(["pack", "--input", f("m.jsonl"), "--out_dir", f("pk")], spark)
    packed = lines(tmp_path / "pk" / "manifest.jsonl")
    names = [r["audio_filepath"].rsplit("/", 1)[1] for r in packed]
    assert len(set(names)) == 20 and "0_0001.wav" not in names and "0_0002.wav" in names
    assert all("audio" not in r and r["tags"][1] == {"x": None} and "note" in r for r in packed)


def test_selection_keeps_fields_and_drops_what_is_no_text(spark, tmp_path):
    f = lambda name: str(tmp_path / name)
    rows = [{"audio_filepath": f"{k}.wav", "text": "one two", "speaker": k % 2, "wer": "own"} for k in range(8)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "p.json").write_text(json.dumps({r["audio_filepath"]: "one" if k % 2 else "one two" for k, r in enumerate(rows)}))
    main(["select-hardest", "--ref", f("m.jsonl"), "--pred", f("p.json"), "--out", f("hard"), "--bottom_q", "0.5", "--easy_ratio", "0", "--group_key", "speaker"], spark)
    got = lines(tmp_path / "hard")
    assert len(got) == 4 and all(r["difficulty"] == "hard" and r["speaker"] in (0, 1) and r["wer"] != "own" for r in got)
    (tmp_path / "o.json").write_text('{"a": "one two", "b": 7, "a": "one three"}')
    (tmp_path / "q.json").write_text('{"a": "one three", "b": "x"}')
    main(["select-hardest", "--ref", f("o.json"), "--pred", f("q.json"), "--out", f("few"), "--bottom_q", "1", "--easy_ratio", "0"], spark)
    assert [(r["audio_filepath"], r["text"], r["wer"]) for r in lines(tmp_path / "few")] == [("a", "one three", 0.0)]


def test_finetuning_scores_segments_by_basic_normalization(spark, tmp_path):
    f = lambda name: str(tmp_path / name)
    (tmp_path / "r.json").write_text(json.dumps({"a": "Ёлка, да", "b": "x y"}))
    (tmp_path / "p.json").write_text(json.dumps({"a": "елка да", "b": "x y"}))
    (tmp_path / "d.json").write_text(json.dumps({"a": 1, "b": 1}))
    main(["select-finetune", f("r.json"), f("p.json"), "--hours", "1", "--durations", f("d.json"), "--output", f("ft")], spark)
    assert {r["audio"]: r["wer"] for r in lines(tmp_path / "ft")} == {"a": 0.5, "b": 0.0}
