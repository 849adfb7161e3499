"""Readers. Lines keep their place (``line_no``) where order has meaning; a byte order mark is always dropped."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.operators import manifests
from speechlake.operators.mixing import dedup_last
from speechlake.session import ship_code
from speechlake.sources import json_split

MANIFEST = "audio_filepath string, audio string, text string, source_lang string, target_lang string, pnc string, dataset string, duration double"
SCORES = "utt_id string, model_id string, ref_norm string, hyp_norm string, wer string, cer string, ser string, sim string, bert_score string, class string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of a text file's lines, or of those of a folder's files by name, that aren't blank. line_no (file, block, place) sorts as the lines stand, however Spark packs files into tasks."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = spark.read.text(path).select("value", place.alias("line_no"))
    return lines.withColumn("value", F.regexp_replace("value", "^﻿", "")).where(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str, schema: str = MANIFEST, strict: bool = True) -> DataFrame:
    """Objects, one a line, with line_no. strict: a malformed line is an error; else it is dropped."""
    return parse_jsonl(_lines(spark, path), schema, strict)


def parse_jsonl(lines: DataFrame, schema: str = MANIFEST, strict: bool = True) -> DataFrame:
    """read_jsonl of (value, line_no)."""
    parsed = lines.withColumn("row", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    # As the only element of a list, a line with text behind its object is malformed too.
    alone = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<map<string,string>>")
    bad = F.col("row._bad").isNotNull() | alone.isNull() | (F.size(alone) != 1)
    if strict:
        checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))).otherwise(F.col("row"))
        return parsed.select(checked.alias("row"), "line_no").select("row.*", "line_no").drop("_bad")
    return parsed.where(~bad).select("row.*", "line_no").drop("_bad")


def read_manifest(spark: SparkSession, path: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """A lenient manifest whose rows keep all their fields: raw is the line as it stands, for writers.write_rows; its key
    (null if it has none), text, dataset and duration, and any named fields as text, beside it; ord keeps the order. Of a
    field that a line repeats the last counts; what is no object, or no JSON, drops."""
    names = dict.fromkeys(["audio_filepath", "audio", "text", "source_lang", "target_lang", "pnc", "dataset", "duration", *fields])
    schema = ", ".join(f"`{n}` string" for n in names)
    lines = _lines(spark, path).select("value", "line_no", F.from_json("value", schema + ", `_bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    alone = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<map<string,string>>")
    good = lines.where(F.col("row._bad").isNull() & alone.isNotNull() & (F.size(alone) == 1) & F.ltrim("value").startswith("{"))
    rows = good.select(F.col("value").alias("raw"), F.col("line_no").alias("ord"), "row.*").drop("_bad")
    return rows.withColumn("audio_filepath", manifests.manifest_key(rows)).withColumn("duration", F.col("duration").try_cast("double")).drop("audio")


def file_names(spark: SparkSession, folder: str) -> DataFrame | None:
    """(name) of the files in a folder, which is listed and not read; None where there is no such folder."""
    try:
        files = spark.read.format("binaryFile").load(folder)
    except AnalysisException:
        return None
    # the listing that the driver holds for any read; a scan would leave out files without bytes
    return spark.createDataFrame([(unquote(x.rsplit("/", 1)[-1]),) for x in files.inputFiles()], "name string")


def read_key_map(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """The last row of each key of a lenient manifest; keyless rows drop."""
    rows = read_jsonl(spark, path, schema, strict=False)
    return dedup_last(rows.withColumn("utt_id", manifests.manifest_key(rows)), "utt_id", "line_no")


def read_json_map(spark: SparkSession, path: str, key: str = "utt_id", value: str = "text", strings_only: bool = False) -> DataFrame:
    """(key, value) of a JSON object from keys to texts, of any size; other values as their JSON text, or dropped. The last of a repeated key counts; broken input is an error."""
    return dedup_last(json_split.read_object(spark, path, key, value, strings_only), key, "place").select(key, value)


def read_json_list(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """(utt_id, text) of a JSON list of objects with audio_filepath or audio, of any size; the last of a repeated key counts, broken input is an error."""
    rows = json_split.read_list(spark, path, schema)
    keyed = rows.withColumn("utt_id", manifests.manifest_key(rows)).select("utt_id", F.coalesce("text", F.lit("")).alias("text"), "place")
    return dedup_last(keyed, "utt_id", "place").select("utt_id", "text")


def read_references(spark: SparkSession, path: str, analyzer: bool = False, strings_only: bool = False) -> DataFrame:
    """(utt_id, text) of references: a manifest (.jsonl), a JSON object, or a JSON list; a later line or entry of a key wins and a null text is empty. strings_only: entries of an object that aren't texts drop."""
    if path.endswith(".jsonl"):
        rows = read_jsonl(spark, path, MANIFEST + ", id string, utt_id string")
        keyed = rows.withColumn("_key", manifests.manifest_key(rows, analyzer)).drop("utt_id").withColumnRenamed("_key", "utt_id")
        return dedup_last(keyed.select("utt_id", "text", "line_no"), "utt_id", "line_no").select("utt_id", F.coalesce("text", F.lit("")).alias("text"))
    if json_split.outer_kind(spark, path) == "[":
        return read_json_list(spark, path)
    return read_json_map(spark, path, strings_only=strings_only).withColumn("text", F.coalesce("text", F.lit("")))


def read_predictions(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(model_id, utt_id, hyp) of a JSON map for each model."""
    out = None
    for model, path in files.items():
        one = read_json_map(spark, path, "utt_id", "hyp").select(F.lit(model).alias("model_id"), "utt_id", F.coalesce("hyp", F.lit("")).alias("hyp"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no predictions given")
    return out


def parse_inputs(items: list[str]) -> dict[str, str]:
    """name=path items; the name defaults to the file's stem."""
    out = {}
    for item in items:
        name, sep, path = item.partition("=")
        if not sep:
            name, path = item.rsplit("/", 1)[-1].rsplit(".", 1)[0], item
        out[name] = path
    return out


def typed_scores(raw: DataFrame, model_id: str | None = None) -> DataFrame:
    """Score columns of text as numbers: blank is 0, rows that can't be read drop, a blank or ``None`` sim is null."""
    number = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(0.0)).otherwise(F.expr(f"try_cast(trim({c}) as double)"))
    rows = raw if model_id is None else raw.where(F.trim("model_id") == model_id)
    rows = rows.withColumns({c: number(c) for c in ("wer", "cer")}).where("wer is not null and cer is not null")
    sim = F.trim(F.coalesce("sim", F.lit("")))
    return rows.withColumn("sim", F.when(sim.isin("", "None"), None).otherwise(F.expr("try_cast(trim(sim) as double)"))).select("utt_id", F.trim("model_id").alias("model_id"), "wer", "cer", "sim")


def read_scores(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame:
    return typed_scores(spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path), model_id)


def read_splits(spark: SparkSession, folder: str, splits: str) -> DataFrame:
    """<folder>/<split>.parquet of each split in ``a+b+c``; a missing one is an error."""
    return spark.read.parquet(*[f"{folder.rstrip('/')}/{s.strip()}.parquet" for s in splits.split("+")])


def read_arrow_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(split, audio_filepath, text) of cached *.arrow files below a folder, split by what their paths name; files that name none drop."""
    ship_code(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.arrow").load(folder).select(manifests.guess_split(F.col("path")).alias("split"), "path", "content").where("split is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                raw = content.as_buffer()
                try:
                    table = pa.ipc.open_stream(raw).read_all()
                except pa.ArrowInvalid:
                    table = pa.ipc.open_file(raw).read_all()
                audio = next((c for c in manifests.CACHE_AUDIO if c in table.column_names), None)
                words = next((c for c in manifests.CACHE_TEXT if c in table.column_names), None)
                if audio is None or words is None:
                    continue
                for part in table.select([audio, words]).to_batches():
                    paths = [(x.get("path") if isinstance(x, dict) else x) or None for x in part.column(0).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([split] * len(paths), pa.string()), pa.array(paths, pa.string()), pa.array([(t or "").strip() for t in part.column(1).to_pylist()], pa.string())], ["split", "audio_filepath", "text"])

    return files.mapInArrow(run, "split string, audio_filepath string, text string").where("audio_filepath is not null")


def audio_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the .wav, .flac and .mp3 files below a folder, which is listed and not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path").where(manifests.is_audio(F.col("path")))


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(audio_filepath, content) of .wav, .flac and .mp3 files below a folder, of one file, or of those that a manifest (.jsonl), a JSON object (its keys) or a JSON list names. Contents are not sorted: order the paths where order has meaning."""
    if path.endswith(".jsonl"):
        rows = read_jsonl(spark, path)
        named = rows.select(manifests.manifest_key(rows).alias("path"))
    elif path.endswith(".json"):
        named = read_references(spark, path).select(F.col("utt_id").alias("path"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.where(manifests.is_audio(F.col("path"))).select(F.col("path").alias("audio_filepath"), "content")
    return read_named_audio(named)


def read_named_audio(named: DataFrame) -> DataFrame:
    """(audio_filepath, content) of the files that the rows (path) name, read where the rows are; a file that can't be read has no content."""
    ship_code(named.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                try:
                    with pa.fs.FileSystem.from_uri(p)[0].open_input_stream(pa.fs.FileSystem.from_uri(p)[1]) if "://" in p else open(p, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([content], pa.binary())], ["audio_filepath", "content"])

    return named.where("path is not null").select("path").mapInArrow(run, "audio_filepath string, content binary")


def open_fields(df: DataFrame, known: list[str]) -> Column:
    """All other columns as one VARIANT, for manifests with fields of their own."""
    rest = [c for c in df.columns if c not in known]
    return F.parse_json(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})) if rest else F.lit(None).cast("variant")
