"""Registered queries that write files, read them back and compare; plugged models; mappers. Each has a DuckDB twin.

Files go to the folder that driver and executors share, a new one for each call. Importing this module registers them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake import sql as S
from speechlake.functions import vectors
from speechlake.operators import inference, manifests, mixing, ranking
from speechlake.plans import harness
from speechlake.queries import _manifest, _utt, query
from speechlake.session import ship_code, work_folder
from speechlake.sources import arrow_shards, readers, writers

#: Entries of one JSON object where a whole table goes out as objects.
ENTRIES = 10_000


def _shards(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // ENTRIES))


# ------------------------------------------------------------------ lines


_M = (S.UTT, S.MANIFEST)


@query(S.with_(*_M) + "SELECT audio_filepath, text, dataset, round(duration, 6) AS duration, CAST(count(*) OVER () AS BIGINT) AS written FROM manifest")
def file_jsonl(spark, d):
    """Written lines, read strictly."""
    path = work_folder(spark, "manifest.jsonl")
    n = writers.write_jsonl(_manifest(spark, d).select("audio_filepath", "text", "dataset", "duration"), path)
    return readers.read_jsonl(spark, path).select("audio_filepath", "text", "dataset", F.round("duration", 6).alias("duration"), F.lit(n).cast("bigint").alias("written"))


@query(S.with_(S.UTT) + "SELECT 'd/' || dataset AS utt_id, arg_max(ref, utt_id) AS text, count(*) AS lines FROM utt WHERE utt_id % 40 <> 7 GROUP BY dataset")
def file_key_map(spark, d):
    """Lenient lines of several files with a mark, broken lines and lines without a key; the last line of a key stands."""
    path, k = work_folder(spark, "lines"), F.col("utt_id")
    row = F.to_json(F.struct(F.concat(F.lit("d/"), "dataset").alias("audio"), F.col("ref").alias("text")))
    lines = _utt(spark, d).select("utt_id", F.concat(F.when(k == 0, "﻿").otherwise(""), F.when(k % 40 == 7, F.concat(F.lit("{"), row)).otherwise(row)).alias("value"))
    nameless = lines.where(k % 40 == 3).withColumn("value", F.lit('{"text":"nobody"}'))
    lines.union(nameless).orderBy("utt_id", "value").select("value").write.text(path)
    per = readers.read_jsonl(spark, path, strict=False).groupBy(F.col("audio").alias("utt_id")).agg(F.count("*").alias("lines"))
    return readers.read_key_map(spark, path).select("utt_id", "text").join(per, "utt_id")


@query(S.with_(S.UTT) + "SELECT CAST(utt_id AS VARCHAR) AS utt_id, CASE WHEN utt_id % 5 = 0 THEN '' ELSE ref END AS text FROM utt")
def file_references(spark, d):
    """References by suffix: a manifest of which every fifth text is null."""
    path, k = work_folder(spark, "refs.jsonl"), F.col("utt_id")
    writers.write_jsonl(_utt(spark, d).select(k.cast("string").alias("audio_filepath"), F.when(k % 5 != 0, F.col("ref")).alias("text")), path)
    return readers.read_references(spark, path)


# ------------------------------------------------------------------ objects and lists


@query(S.with_(S.UTT, S.PREDS) + "SELECT model_id, CAST(utt_id AS VARCHAR) AS utt_id, hyp FROM preds WHERE model_id <> 'm2'")
def file_prediction_maps(spark, d):
    """Prediction maps, given as name=path, or as a path whose stem is the name."""
    base, preds = work_folder(spark, "maps"), harness.predictions(_utt(spark, d))
    for model in ("m1", "m3"):
        own = preds.where(F.col("model_id") == model)
        writers.write_prediction_shards(own, f"{base}/{model}.json", shards=_shards(own))
    return readers.read_predictions(spark, readers.parse_inputs([f"m1={base}/m1.json", f"{base}/m3.json"]))


@query(S.with_(S.UTT) + "SELECT CAST(utt_id AS VARCHAR) AS utt_id, ref AS text FROM utt WHERE utt_id % 3 <> 1")
def file_json_strings(spark, d):
    """JSON objects of which every third value is a number: strings alone are kept."""
    path, utt = work_folder(spark, "objects.json"), _utt(spark, d)
    k = F.col("utt_id")
    value = F.when(k % 3 == 1, "7").otherwise(F.regexp_replace(F.to_json(F.array("ref")), r"^\[|\]$", ""))  # a quoted text without the list's brackets
    entries = utt.select(F.pmod(F.xxhash64("utt_id"), F.lit(_shards(utt))).alias("shard"), F.concat(F.lit('"'), k.cast("string"), F.lit('":'), value).alias("e"))
    entries.groupBy("shard").agg(F.concat(F.lit("﻿{"), F.array_join(F.collect_list("e"), ", "), F.lit("}")).alias("value")).write.partitionBy("shard").text(path)
    return readers.read_json_map(spark, path, strings_only=True)


@query(S.with_(S.UTT) + "SELECT CAST(utt_id AS VARCHAR) AS utt_id, CASE WHEN utt_id % 5 = 0 THEN '' ELSE ref END AS text FROM utt WHERE utt_id % 4 <> 3")
def file_json_list(spark, d):
    """JSON lists of objects that name their audio in either field or, every fourth, in none."""
    path, utt, k = work_folder(spark, "list.json"), _utt(spark, d), F.col("utt_id")
    key = k.cast("string")
    one = F.struct(F.when(k % 4 == 0, key).alias("audio_filepath"), F.when(k % 4 != 3, key).alias("audio"), F.when(k % 5 != 0, F.col("ref")).alias("text"))
    rows = utt.select(F.pmod(F.xxhash64("utt_id"), F.lit(_shards(utt))).alias("shard"), one.alias("one"))
    rows.groupBy("shard").agg(F.to_json(F.collect_list("one")).alias("value")).write.partitionBy("shard").text(path)
    return readers.read_references(spark, path)


# ------------------------------------------------------------------ score tables


@query(
    S.with_(S.UTT)
    + """SELECT CAST(utt_id AS VARCHAR) AS utt_id, 'm' || CAST(utt_id % 2 AS VARCHAR) AS model_id, CASE WHEN utt_id % 9 = 0 THEN 0.0 ELSE (utt_id % 8) / 8.0 END AS wer, (utt_id % 16) / 16.0 AS cer,
  CASE WHEN utt_id % 3 = 0 THEN NULL ELSE (utt_id % 4) / 4.0 END AS sim FROM utt WHERE utt_id % 2 = 1 AND utt_id % 14 <> 3"""
)
def file_scores(spark, d):
    """A score table as CSV, quotes and commas in its texts; one model's rows are read, blanks are 0, what is no number drops."""
    path, k = work_folder(spark, "scores.csv"), F.col("utt_id")
    table = _utt(spark, d).select(
        k.cast("string").alias("utt_id"), F.concat(F.lit(" m"), (k % 2).cast("string")).alias("model_id"), F.concat(F.lit('say "'), "ref", F.lit('", then')).alias("ref_norm"),
        F.when(k % 14 == 3, "n/a").when(k % 9 == 0, "").otherwise((k % 8 / 8).cast("string")).alias("wer"), (k % 16 / 16).cast("string").alias("cer"),
        F.when(k % 6 == 0, "None").when(k % 3 == 0, "").otherwise((k % 4 / 4).cast("string")).alias("sim"),
    )
    if not writers.write_csv(table, path):
        return readers.typed_scores(table, "m1")
    return readers.read_scores(spark, path, "m1")


# ------------------------------------------------------------------ cuts


@query(
    S.with_(*_M)
    + """SELECT printf('r%08d', rn) AS recording_id, '/data/' || audio_filepath AS audio_filepath, round(duration, 6) AS duration, printf('r%08d-0', rn) AS sup_id, text, 'ru' AS language, 'yes' AS pnc
  FROM (SELECT *, row_number() OVER (ORDER BY utt_id) AS rn FROM manifest)"""
)
def file_cuts(spark, d):
    """Cuts, compressed, written and read back."""
    path = work_folder(spark, "cuts.jsonl.gz")
    writers.write_cuts(manifests.cut_manifest(_manifest(spark, d), "utt_id", "/data"), path)
    cut = "recording_id string, audio_filepath string, duration double, supervision struct<id: string, text: string, language: string, custom: struct<pnc: string>>"
    rows = readers.read_jsonl(spark, path, cut)
    return rows.select("recording_id", "audio_filepath", F.round("duration", 6).alias("duration"), F.col("supervision.id").alias("sup_id"), "supervision.text", "supervision.language", "supervision.custom.pnc")


# ------------------------------------------------------------------ cached shards


@query(
    r"""SELECT CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, 'c/' || CAST(doc_id AS VARCHAR) AS audio_filepath,
  regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 11 <> 5"""
)
def file_arrow_shards(spark, d):
    """Cached Arrow files below folders that name splits, or none; rows without a path drop."""
    ship_code(spark)
    base = work_folder(spark, "cache")
    docs = harness.table(spark, d, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = writers.file_system(base)
        for n, batch in enumerate(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r, folder in enumerate(("train-00", "dev", "x/test", "other")):
                mine = [(i, t) for i, t in zip(ids, texts, strict=True) if i % 4 == r]
                table = pa.table({"audio": pa.array([{"path": None if i % 11 == 5 else f"c/{i}"} for i, _ in mine], pa.struct([("path", pa.string())])), "sentence": pa.array([t for _, t in mine], pa.string())})
                store.create_dir(f"{root}/{folder}")
                with store.open_output_stream(f"{root}/{folder}/{TaskContext.get().partitionId()}-{n}.arrow") as out, pa.ipc.new_stream(out, table.schema) as w:
                    w.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)])], ["n"])

    docs.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return readers.read_arrow_shards(spark, base)


# ------------------------------------------------------------------ audio


_CLIPS = r"""clips AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '')) AS n, row_number() OVER (ORDER BY item_id) - 1 AS ord FROM benchmark)"""


def _dumped(spark: SparkSession, d: str) -> DataFrame:
    """A WAV file for each benchmark item, 1,600 samples a word, every seventh without audio; gives (audio_filepath, content)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    rows = ranking.row_numbers(harness.table(spark, d, "benchmark").select("item_id", "text"), [F.col("item_id")]).withColumn("ord", F.col("rn") - 1)
    audio = rows.select("ord", F.when(F.col("ord") % 7 != 3, F.array_repeat(F.lit(0.25).cast("float"), F.size(words) * 1600)).alias("array"), "text")
    folder = work_folder(spark, "wav")
    writers.dump_wavs(audio, folder).agg(F.sum("duration")).collect()
    return readers.read_audio(spark, folder)


@query(S.with_(_CLIPS) + "SELECT printf('utt_%06d.wav', ord) AS name, n / 10.0 AS duration FROM clips WHERE ord % 7 <> 3")
def file_wavs(spark, d):
    """Dumped audio: names by place, seconds from the headers."""
    return inference.with_durations(_dumped(spark, d)).select(F.element_at(F.split("audio_filepath", "/"), -1).alias("name"), "duration")


@query(S.with_(_CLIPS) + "SELECT printf('utt_%06d.wav', ord) AS name, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_transform(range(0, CAST(ceil(n / 10.0) AS BIGINT)), lambda k: CAST(CAST(least(15, n - 10 * k) * 1600 AS BIGINT) AS VARCHAR)), ' ') END AS hyp FROM clips WHERE ord % 7 <> 3")
def recognize_recordings(spark, d):
    """Windows of 1.5 seconds each second through a model that tells how many samples it heard."""

    def load():
        import io
        import wave

        def samples(clip: bytes) -> str:
            with wave.open(io.BytesIO(clip)) as w:
                return str(w.getnframes())

        return lambda clips: [samples(c) for c in clips]

    found = inference.recognize_long(_dumped(spark, d), load, window=1.5, hop=1.0)
    return found.select(F.element_at(F.split("audio_filepath", "/"), -1).alias("name"), "hyp")


# ------------------------------------------------------------------ plugged models


@query(S.with_(S.UTT) + "SELECT utt_id, CASE WHEN length(ref) > 150 THEN 'long' ELSE coalesce(lang, 'ru') || (CASE WHEN utt_id % 2 = 0 THEN ':asr:' ELSE ':translate:' END) || CAST(octet_length(encode(ref)) AS VARCHAR) END AS hyp FROM utt")
def recognize_arguments(spark, d):
    """A model that gets a language and a task for each clip; a batch of long clips is refused and goes to a second model."""

    def load():
        def first(batch):
            clips, rows = zip(*batch, strict=True)
            if any(r["size"] > 150 for r in rows):
                raise ValueError("too long")
            return [f"{r['lang']}:{r['task']}:{len(c)}" for c, r in zip(clips, rows, strict=True)]

        def second(batch):
            return ["long" if batch[0][1]["size"] > 150 else first(batch)[0]]

        both = inference.with_fallback(first, second)
        return lambda clips, rows: both(list(zip(clips, rows, strict=True)))

    k = F.col("utt_id")
    clips = _utt(spark, d).select(k.cast("string").alias("audio_filepath"), F.encode("ref", "UTF-8").alias("content"), F.coalesce("lang", F.lit("ru")).alias("lang"), F.when(k % 2 == 0, "asr").otherwise("translate").alias("task"), F.length("ref").alias("size"))
    out = inference.recognize_speech(clips, load, size=inference.batch_size("turbo"), arguments=("lang", "task", "size"))
    return out.select(F.col("audio_filepath").cast("bigint").alias("utt_id"), "hyp")


_PAIRED = "paired AS (SELECT u.utt_id, u.ref, p.hyp FROM utt u JOIN preds p ON p.utt_id = u.utt_id AND p.model_id = 'm2')"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    utt = _utt(spark, d)
    return utt.select("utt_id", "ref").join(harness.predictions(utt).where("model_id = 'm2'").select("utt_id", "hyp"), "utt_id")


_SHARED = "CAST(len(list_intersect(string_split(ref, ' '), string_split(hyp, ' '))) AS DOUBLE)"


@query(S.with_(S.UTT, S.PREDS, _PAIRED) + f"SELECT utt_id, round(2 * {_SHARED} / (len(list_distinct(string_split(ref, ' '))) + len(list_distinct(string_split(hyp, ' ')))), 6) AS bert_score FROM paired")
def pair_scores(spark, d):
    """A plugged scorer of two texts: F1 of their distinct words."""

    def f1(a, b):
        sets = [(set(x.split(" ")), set(y.split(" "))) for x, y in zip(a, b, strict=True)]
        return [2 * len(x & y) / (len(x) + len(y)) for x, y in sets]

    ship_code(spark)
    return vectors.pair_scores(_paired(spark, d), "ref", "hyp", f1).select("utt_id", F.round("bert_score", 6).alias("bert_score"))


_VEC = "[CAST(length({0}) AS DOUBLE), CAST(length({0}) - length(replace({0}, 'e', '')) AS DOUBLE), CAST(length({0}) - length(replace({0}, ' ', '')) AS DOUBLE)]"
_A, _B = _VEC.format("ref"), _VEC.format("hyp")


@query(S.with_(S.UTT, S.PREDS, _PAIRED) + f"SELECT utt_id, round(list_dot_product({_A}, {_B}) / (sqrt(list_dot_product({_A}, {_A})) * sqrt(list_dot_product({_B}, {_B})) + 1e-8), 6) AS sim FROM paired")
def encoded_cosine(spark, d):
    """A plugged encoder, asked once for each distinct text; the cosine of two texts."""

    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), float(t.count("e")), float(t.count(" "))])

    ship_code(spark)
    return vectors.text_similarity(_paired(spark, d), "ref", "hyp", encode).select("utt_id", F.round("sim", 6).alias("sim"))


_LONG = "list_filter(string_split(ref, ' '), lambda t: length(t) > 14)"
_CAPITAL = "list_filter(string_split(ref, ' '), lambda t: t <> '' AND left(t, 1) <> lower(left(t, 1)) AND t <> upper(t))"


@query(S.with_(S.UTT) + f"SELECT utt_id, CASE WHEN len({_LONG}) > 0 THEN array_to_string({_LONG}, ' ') ELSE array_to_string({_CAPITAL}, ' ') END AS names, CASE WHEN len({_LONG}) > 0 THEN 'NAME' WHEN len({_CAPITAL}) > 0 THEN 'PER?' END AS kind FROM utt")
def recognize_names(spark, d):
    """A plugged model of names (words of over 14 letters); capitalized words where it finds none."""
    ship_code(spark)
    found = inference.recognize_names(_utt(spark, d), "ref", lambda texts: [[w for w in t.split(" ") if len(w) > 14] for t in texts])
    return found.select("utt_id", F.array_join("entities.text", " ").alias("names"), F.get("entities.kind", F.lit(0)).alias("kind"))


# ------------------------------------------------------------------ mappers and fields


@query(
    S.with_(S.UTT)
    + r"""SELECT 'common_voice' AS mapper, utt_id, 'c/' || CAST(utt_id AS VARCHAR) AS audio_filepath, CASE WHEN utt_id % 2 = 0 THEN ' ' || ref || ' ' ELSE ref END AS text FROM utt WHERE utt_id % 6 <> 5
  UNION ALL SELECT 'generic', utt_id, 'c/' || CAST(utt_id AS VARCHAR), CASE WHEN utt_id % 2 = 0 THEN trim(ref) ELSE ref END FROM utt WHERE utt_id % 6 <> 5
  UNION ALL SELECT 'custom', utt_id, 'c/' || CAST(utt_id AS VARCHAR), CASE WHEN utt_id % 4 = 1 THEN '' ELSE CAST(utt_id AS VARCHAR) END FROM utt WHERE utt_id % 6 <> 5"""
)
def mapper_dispatch(spark, d):
    """The mappers of two data sets by name, and one of named columns; rows without a path drop."""
    k = F.col("utt_id")
    rows = _utt(spark, d).select(
        "utt_id", F.when(k % 6 != 5, F.concat(F.lit("c/"), k.cast("string"))).otherwise("").alias("path"), F.when(k % 2 == 0, F.concat(F.lit(" "), "ref", F.lit(" "))).otherwise("").alias("sentence"),
        F.when(k % 2 == 1, F.col("ref")).alias("text"), F.when(k % 4 != 1, k).alias("number"),
    )
    out = None
    for name, mapped in (
        ("common_voice", manifests.choose_mapper("mozilla/Common_Voice_17")(rows, ["utt_id"])),
        ("generic", manifests.choose_mapper("golos")(rows, ["utt_id"])),
        ("custom", manifests.map_custom(rows, "path", "number", ["utt_id"])),
    ):
        one = mapped.select(F.lit(name).alias("mapper"), "utt_id", "audio_filepath", "text")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    S.with_(S.UTT)
    + """SELECT utt_id, CASE utt_id % 3 WHEN 0 THEN 'org/' || dataset WHEN 1 THEN 'org/' || dataset || '___x' ELSE dataset END AS repo, 'ru' AS source_lang, 'en' AS target_lang, 'yes' AS pnc,
  CASE WHEN utt_id % 2 = 0 THEN 'clips/' || CAST(utt_id AS VARCHAR) ELSE '/else/' || CAST(utt_id AS VARCHAR) END AS relative, CASE utt_id % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'P' WHEN 2 THEN 'S' ELSE CAST(NULL AS VARCHAR) END AS hyp FROM utt"""
)
def field_rules(spark, d):
    """Names of repositories, constant fields, paths seen from a folder, texts of hypothesis rows."""
    k = F.col("utt_id")
    repo = F.when(k % 3 == 0, F.concat(F.lit("org___"), "dataset")).when(k % 3 == 1, F.concat(F.lit("org/"), "dataset", F.lit("___x"))).otherwise(F.col("dataset"))
    path = F.when(k % 2 == 0, F.concat(F.lit("\\base\\clips\\"), k.cast("string"))).otherwise(F.concat(F.lit("/else/"), k.cast("string")))
    rows = _utt(spark, d).select("utt_id", F.when(k % 4 == 0, "T").alias("text"), F.when(k % 4 <= 1, "P").alias("pred_text"), F.when(k % 4 == 2, "S").alias("spoken"), repo.alias("_r"), path.alias("_p"))
    hyp = manifests.hypothesis_text(rows.select("text", "pred_text", "spoken"))
    named = rows.select("utt_id", manifests.normalize_repo_id(F.col("_r")).alias("repo"), writers.relative_path(F.col("_p"), "/base").alias("relative"), hyp.alias("hyp"))
    return manifests.attach_constants(named, target_lang="en")


_LABELS = "list_transform(string_split(ref, ' '), lambda t: CAST(length(t) AS INTEGER))"


@query(S.with_(S.UTT) + f"SELECT utt_id, array_to_string(list_concat(list_slice({_LABELS}, 1, 20), list_transform(range(0, greatest(0, 20 - len({_LABELS}))), lambda k: -100)), ',') AS labels FROM utt")
def pad_and_mask(spark, d):
    """Label lists of one length, padded with a mask."""
    labels = F.transform(F.split("ref", " "), lambda t: F.length(t))
    padded = manifests.pad_and_mask(_utt(spark, d).select("utt_id", labels.alias("labels")), "labels", 20)
    return padded.select("utt_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(S.with_(*_M) + "SELECT utt_id, round(duration, 6) AS duration FROM manifest WHERE duration <= 0.9 ORDER BY utt_id LIMIT 64")
def short_audio(spark, d):
    """The first 64 clips of a known duration up to a cap."""
    short = manifests.duration_filter(_manifest(spark, d), None, 0.9, null_passes=False)
    return mixing.limit_rows(short, 64, "utt_id").select("utt_id", F.round("duration", 6).alias("duration"))


@query("SELECT source, round(sqrt(n) / sum(sqrt(n)) OVER (), 6) AS share FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)")
def temperature_shares(spark, d):
    """Shares of sources by the root of their rows."""
    counts = harness.table(spark, d, "documents").where("source is not null").groupBy("source").count()
    return mixing.temperature_shares(counts, "count").select("source", F.round("share", 6).alias("share"))


# ------------------------------------------------------------------ reports


_LANGS = "langs AS (SELECT coalesce(lang, 'none') AS lang, count(*) AS n, round(avg(length(ref)), 1) AS chars FROM utt GROUP BY 1)"


def _langs(spark: SparkSession, d: str) -> DataFrame:
    return _utt(spark, d).groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("ref")), 1).alias("chars")).orderBy("lang")


@query(S.with_(S.UTT, _LANGS) + "SELECT string_agg('lang=' || lang || '  n=' || CAST(n AS VARCHAR) || '  chars=' || printf('%.4f', chars), chr(10) ORDER BY lang) AS report FROM langs")
def console_report(spark, d):
    return spark.createDataFrame([(writers.console(_langs(spark, d)) or None,)], "report string")


@query(
    S.with_(S.UTT, _LANGS)
    + """SELECT '<h2>Models</h2><table><tr><th>lang</th><th>n</th></tr>' || string_agg('<tr><td>&lt;' || lang || '&gt;</td><td>' || CAST(n AS VARCHAR) || '</td></tr>', '' ORDER BY lang)
  || '</table><h2>Substitutions</h2><p>no rows</p><h2>Operations</h2><p>no rows</p>' AS body FROM langs"""
)
def html_report(spark, d):
    """Three tables, every value escaped, two of them empty."""
    named = _langs(spark, d).select(F.concat(F.lit("<"), "lang", F.lit(">")).alias("lang"), "n")
    none = named.where("false")
    page = writers.html_report(named, none, none)
    return spark.createDataFrame([(page.split("<body>")[1].split("</body>")[0],)], "body string")


# ------------------------------------------------------------------ fields of their own, repeated keys, clashing names


@query(S.with_(S.UTT) + "SELECT CAST(utt_id AS VARCHAR) AS audio_filepath, ref AS text, CASE WHEN utt_id % 7 <> 0 THEN 's' || CAST(utt_id % 5 AS VARCHAR) END AS speaker, CASE utt_id % 3 WHEN 0 THEN dataset ELSE 'tag' END AS dataset, utt_id % 7 = 0 AS bare FROM utt")
def file_own_fields(spark, d):
    """A manifest with a field of its own, absent in every seventh row, tagged, written and read back: what was absent is absent."""
    path, k = work_folder(spark, "fields.jsonl"), F.col("utt_id")
    row = F.struct(k.cast("string").alias("audio"), F.col("ref").alias("text"), F.when(k % 7 != 0, F.concat(F.lit("s"), (k % 5).cast("string"))).alias("speaker"), F.when(k % 3 == 0, F.col("dataset")).alias("dataset"))
    _utt(spark, d).select(F.to_json(row).alias("value")).write.text(path)
    again = work_folder(spark, "tagged.jsonl")
    writers.write_rows(mixing.concat_tagged({"tag": readers.read_manifest(spark, path)}), again, ("dataset",))
    rows = readers.read_manifest(spark, again, ("speaker",))
    return rows.select("audio_filepath", "text", "speaker", "dataset", (~F.contains("raw", F.lit('"speaker":'))).alias("bare"))


@query(S.with_(S.UTT, S.PREDS) + "SELECT CAST(utt_id AS VARCHAR) AS utt_id, hyp AS text, 'map' AS way FROM preds WHERE model_id = 'm1' UNION ALL SELECT CAST(utt_id AS VARCHAR), ref, 'object' FROM utt")
def file_repeated_keys(spark, d):
    """Maps of a table that repeats its keys, and objects that repeat theirs: the last counts."""
    base, utt = work_folder(spark, "repeats"), _utt(spark, d)
    own = harness.predictions(utt).where("model_id = 'm1'")
    twice = own.select("utt_id", F.lit("zz, an older one").alias("hyp"), F.lit(0).alias("place")).unionByName(own.select("utt_id", "hyp", F.lit(1).alias("place")))
    writers.write_prediction_shards(twice, f"{base}/map.json", shards=_shards(own), order="place")
    quoted = F.regexp_replace(F.to_json(F.array("ref")), r"^\[|\]$", "")
    name = F.concat(F.lit('"'), F.col("utt_id").cast("string"), F.lit('": '))
    entries = utt.select(F.pmod(F.xxhash64("utt_id"), F.lit(_shards(utt))).alias("shard"), F.concat(name, F.lit('"older, {\\"", '), name, quoted).alias("e"))
    entries.groupBy("shard").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("e"), ",\n"), F.lit("}")).alias("value")).write.partitionBy("shard").text(f"{base}/object.json")
    return readers.read_json_map(spark, f"{base}/map.json").withColumn("way", F.lit("map")).unionByName(readers.read_json_map(spark, f"{base}/object.json").withColumn("way", F.lit("object")))


def clashing_paths(spark, d) -> DataFrame:
    """(utt_id, audio_filepath): names of which many are alike, and many what the rule would make of others."""
    k = F.col("utt_id")
    stem = F.concat(F.lit("clip"), F.pmod(F.xxhash64("utt_id"), F.lit(40)).cast("string"), F.when(k % 4 == 0, "_0001").when(k % 9 == 0, "_0007").when(k % 50 == 3, "_0001_0002").otherwise(""))
    return _utt(spark, d).select("utt_id", F.concat(F.lit("data/"), "dataset", F.lit("/"), stem, F.when(k % 6 == 1, ".flac").otherwise(".wav")).alias("audio_filepath"))


@query()
def pack_clashing_names(spark, d):
    """Names of their own for files of which many clash, in a folder that holds some; tested against the rule applied file by file."""
    there = spark.createDataFrame([("clip1.wav",), ("clip2_0001.wav",), ("clip3_0009.wav",)], "name string")
    return manifests.pack_rename(clashing_paths(spark, d), "utt_id", there)


# ------------------------------------------------------------------ lengths from headers


def _audio_bytes(kind: int, n: int) -> bytes:
    """A file of n tenths of a second at 8 kHz (WAV, FLAC), or of n frames of 417 bytes at 128 kbit/s (MP3); silence."""
    if kind == 0:
        return b"RIFF" + struct.pack("<I", 36 + 1600 * n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 1600 * n) + bytes(1600 * n)
    if kind == 1:
        return b"fLaC\x80\x00\x00\x22" + bytes(10) + ((8000 << 44) | (15 << 36) | 800 * n).to_bytes(8, "big") + bytes(16 + 100 * n)
    return (b"\xff\xfb\x90\xc0" + bytes(413)) * n


@query("SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN (1 + doc_id % 7) * 417 * 8 / 128000.0 ELSE (1 + doc_id % 7) / 10.0 END::DOUBLE AS duration, TRUE AS headers_only FROM documents")
def file_audio_lengths(spark, d):
    """Lengths of WAV, FLAC and MP3 files, one for each document, from ranged reads of their headers."""
    ship_code(spark)
    folder = work_folder(spark, "audio")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = writers.file_system(folder)
        store.create_dir(root)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            names = [f"{folder}/{i}.{('wav', 'flac', 'mp3')[i % 3]}" for i in ids]
            for i, name in zip(ids, names, strict=True):
                with store.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}") as out:
                    out.write(_audio_bytes(i % 3, 1 + i % 7))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names)], ["doc_id", "path"])

    made = harness.table(spark, d, "documents").select("doc_id").mapInArrow(write, "doc_id long, path string")
    listed = work_folder(spark, "listed")
    made.write.parquet(listed)
    named = spark.read.parquet(listed)
    found = inference.named_durations(named)
    return named.join(found, named["path"] == found["audio_filepath"]).select("doc_id", "duration", (F.col("bytes_read") <= 70_000).alias("headers_only"))


@query(
    r"""SELECT CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 4 <> 3"""
)
def file_arrow_ranges(spark, d):
    """Cached Arrow shards by the source that cuts them into ranges of record batches: two columns of three, shards that name a split."""
    ship_code(spark)
    base = work_folder(spark, "shards")
    rows = harness.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = writers.file_system(base)
        n = 0
        for batch in batches:
            for k, name in enumerate(("train", "valid", "test", "other")):
                mine = batch.filter(pa.array([i % 4 == k for i in batch.column(0).to_pylist()]))
                if mine.num_rows:
                    store.create_dir(f"{root}/{name}")
                    with store.open_output_stream(f"{root}/{name}/{TaskContext.get().partitionId()}-{n}.arrow") as out, pa.ipc.new_stream(out, mine.schema) as w:
                        for b in pa.Table.from_batches([mine]).to_batches(max_chunksize=100):
                            w.write_batch(b)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    listed = work_folder(spark, "listed")
    rows.select("doc_id", "text", F.lit("unused").alias("more")).mapInArrow(write, "n long").write.parquet(listed)
    if not sum(r.n for r in spark.read.parquet(listed).groupBy().agg(F.sum("n").alias("n")).collect() if r.n):
        return rows.select(F.lit("").alias("split"), "doc_id", "text").limit(0)
    spark.dataSource.register(arrow_shards.ArrowShards)
    return spark.read.format("arrow_shards").option("columns", "doc_id,text").load(base).where("split is not null").select("split", "doc_id", "text")


# ------------------------------------------------------------------ signal and noise


def _recording(i: int) -> bytes:
    """Noise of one strength with bursts of another, both square waves whose energies are known, at 8 kHz. Their tone, 2 kHz, lies in the band that resampling keeps."""
    low = 50 + i % 20
    high, burst = low * (2 + i % 9), 10 + i % 7
    frames = [low] * 30 + ([high] * burst + [low] * 20) * (1 + i % 5)
    x = (np.repeat(np.array(frames), 80) * np.tile([1, 1, -1, -1], 20 * len(frames))).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(x)) + x


@query(
    """WITH a AS (SELECT doc_id, 50 + doc_id % 20 AS low, 2 + doc_id % 9 AS times, 10 + doc_id % 7 AS burst, 1 + doc_id % 5 AS n FROM documents)
SELECT doc_id, round((30 + n * (burst + 20)) / 100.0::DOUBLE, 6) AS duration, round(n * burst / 100.0::DOUBLE, 6) AS speech_seconds, round(10 * log10(times * times - 1), 6) AS snr_db FROM a WHERE times >= 3"""
)
def audio_signal_filter(spark, d):
    """Recordings, one for each document, measured and filtered: those whose bursts stand high enough above their noise."""
    ship_code(spark)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_recording(i) for i in batch.column(0).to_pylist()], pa.binary())], ["doc_id", "content"])

    made = harness.table(spark, d, "documents").select("doc_id").mapInArrow(make, "doc_id long, content binary")
    kept = inference.signal_filter(inference.with_signal(made), 5.0)
    return kept.select("doc_id", F.round("duration", 6).alias("duration"), F.round("speech_seconds", 6).alias("speech_seconds"), F.round("snr_db", 6).alias("snr_db"))


@query("SELECT doc_id, (30 + (1 + doc_id % 5) * (30 + doc_id % 7)) * 160 AS n_samples, 80 AS n_mels, 30 + (1 + doc_id % 5) * (30 + doc_id % 7) AS n_frames, TRUE AS loud FROM documents")
def audio_features(spark, d):
    """Recordings, one for each document, at 16 kHz and as mel features; loud: the highest band's level is in the last frames of a burst, not in the noise before the first."""
    ship_code(spark)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_recording(i) for i in batch.column(0).to_pylist()], pa.binary())], ["doc_id", "content"])

    made = harness.table(spark, d, "documents").select("doc_id").mapInArrow(make, "doc_id long, content binary")
    found = inference.with_features(made, seconds=None)
    level = lambda a, z: F.array_max(F.transform("features", lambda band: F.array_max(F.slice(band, a, z))))
    return found.select("doc_id", "n_samples", F.size("features").alias("n_mels"), F.size(F.col("features")[0]).alias("n_frames"), (level(32, 8) > level(2, 26)).alias("loud"))
