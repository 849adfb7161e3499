"""JSON read in byte ranges: equal to a plain parser whatever the ranges; repeated keys; broken input; a large object is many tasks."""

import json
import random

import pytest

from speechlake.sources import json_split, readers


@pytest.fixture(params=[100, 1 << 20])
def ranges(spark, request):
    """Byte ranges of about so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


ODD = ['plain', 'a, b, "c"', '{not: [an, object]}', 'back\\slash\\', '\\"', '', ',,,', 'é   ü', 'line\nbreak, and\ttab', '}]', 'x' * 90 + ',' + 'y' * 60]


def test_objects(spark, tmp_path, ranges):
    want = {f"k{k}, \"{{[{k}": v for k, v in enumerate(ODD)}
    for indent in ((None, 2) if ranges > 100 else (2,)):
        p = tmp_path / f"o{indent}.json"
        p.write_text(("﻿" if indent else "") + json.dumps(want, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
        got = {r.utt_id: r.text for r in readers.read_json_map(spark, str(p)).collect()}
        assert got == want


def test_repeated_keys_and_other_values(spark, tmp_path, ranges):
    p = tmp_path / "o.json"
    p.write_text('{"a": "1, x", "b": null, "c": [1, {"d": "}"}], "a": "2", "e": 7.5, "f": true, "a": "3 ]", "e": "last", "c": {"x": [], "y": ","}}')
    got = {r.utt_id: r.text for r in readers.read_json_map(spark, str(p)).collect()}
    assert got == {"a": "3 ]", "b": None, "c": '{"x":[],"y":","}', "e": "last", "f": "true"}
    strings = {r.utt_id: r.text for r in readers.read_json_map(spark, str(p), strings_only=True).collect()}
    assert strings == {"a": "3 ]", "e": "last"}
    assert {r.utt_id: r.text for r in readers.read_references(spark, str(p), strings_only=True).collect()} == strings


def test_lists(spark, tmp_path, ranges):
    rows = [{"audio_filepath": f"{k}.wav", "text": v} for k, v in enumerate(ODD)] + [{"audio": "a, b.wav", "text": None}, {"text": "nobody"}, {"audio": "0.wav", "text": "later"}, 7, "text", [1, 2], None]
    p = tmp_path / "l.json"
    p.write_text(json.dumps(rows))
    want = {}
    for r in rows:
        if isinstance(r, dict) and (r.get("audio_filepath") or r.get("audio")):
            want[r.get("audio_filepath") or r.get("audio")] = r["text"] or ""
    assert {r.utt_id: r.text for r in readers.read_references(spark, str(p)).collect()} == want


@pytest.mark.parametrize("text", ["", "  \n", "{}", " { } ", "[]", "﻿[ ]\n"])
def test_empty(spark, tmp_path, text):
    p = tmp_path / "e.json"
    p.write_text(text, encoding="utf-8")
    assert json_split.entries(spark, str(p)).collect() == []


@pytest.mark.parametrize("text", ['{"a": "x"', '{"a": "x}', '{"a": 1}}', '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', '{"a" 1}', '{"a": 1 "b": 2}', '{"a": 1,}', '{,"a": 1}', '{"a": 1,, "b": 2}', '{"a": tru}', '["a", "b"]', '"text"', "7", '{"a": [1, 2}, "b": 3]', '{"a": 1}x', '{"a": "\\,"}', "{a}"])
def test_broken_objects_are_errors(spark, tmp_path, text):
    p = tmp_path / "b.json"
    p.write_text(text)
    with pytest.raises(Exception, match="(?i)broken JSON|malformed"):
        readers.read_json_map(spark, str(p)).collect()


@pytest.mark.parametrize("text", ['[{"text": "x"}', '[{"audio": "a"} {"audio": "b"}]', '[{"audio": "a"},]', '[{"audio": }]', '{"a": 1}', '[{"audio": "a"]}'])
def test_broken_lists_are_errors(spark, tmp_path, text):
    p = tmp_path / "b.json"
    p.write_text(text)
    with pytest.raises(Exception, match="(?i)broken JSON|malformed"):
        readers.read_json_list(spark, str(p)).collect()


def test_random_objects(spark, tmp_path, ranges):
    rng = random.Random(ranges)
    text = lambda: "".join(rng.choice('ab,"{}[]\\: \n') for _ in range(rng.randrange(30)))
    for k in range(1):
        want = {text(): text() for _ in range(40)}
        p = tmp_path / f"r{k}.json"
        p.write_text(json.dumps(want))
        assert {r.utt_id: r.text for r in readers.read_json_map(spark, str(p)).collect()} == want


def test_several_files_and_many_tasks(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 2000)):
        (tmp_path / f"{name}.json").write_text(json.dumps({f"k{k}": f"{name}, {k}" for k in range(n)}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert json_split._records(spark, str(tmp_path)).rdd.getNumPartitions() > 6
        got = {r.utt_id: r.text for r in readers.read_json_map(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 3000 and got["k1999"] == "b, 1999" and got["k2000"] == "a, 2000"
