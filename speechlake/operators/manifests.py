"""Building manifests: coalescing differing schemas, filters, names, cuts, counters."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from speechlake.functions import alignment, text
from speechlake.operators import naming
from speechlake.operators.ranking import group_row_numbers, row_numbers
from speechlake.session import ship_code

#: Columns that may hold the audio path and the transcript, in order of preference.
AUDIO_FIELDS = ["audio", "path", "file", "audio_filepath"]
TEXT_FIELDS = ["sentence", "text", "normalized_text", "normalized", "transcript", "transcription", "raw_transcription"]
#: The same for tables of cached shards.
CACHE_AUDIO, CACHE_TEXT = ["audio", "path", "file", "audio_filepath"], ["text", "sentence", "transcription", "normalized_text"]


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def manifest_key(df: DataFrame, analyzer: bool = False) -> Column:
    """The row's key: audio_filepath or audio; the analyzer takes audio_filepath, id or utt_id."""
    names = ["audio_filepath", "id", "utt_id"] if analyzer else ["audio_filepath", "audio"]
    found = [blank_to_null(F.col(c).cast("string")) for c in names if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def audio_path(df: DataFrame, fields: list[str] | None = None) -> Column:
    """The first field that holds a path: a string, or the path of a struct."""
    found = []
    for c in fields or AUDIO_FIELDS:
        if c in df.columns:
            kind = df.schema[c].dataType
            if isinstance(kind, StructType) and "path" in kind.names:
                found.append(blank_to_null(F.col(f"{c}.path")))
            elif isinstance(kind, StringType):
                found.append(blank_to_null(F.col(c)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def transcript(df: DataFrame, fields: list[str] | None = None, any_string: bool = False) -> Column:
    """The first field that isn't blank, trimmed, else an empty text; any_string: else the first string column of any name that isn't blank."""
    names = [c for c in fields or TEXT_FIELDS if c in df.columns and isinstance(df.schema[c].dataType, StringType)]
    if any_string:
        names += [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in names]
    return F.coalesce(*[blank_to_null(strip(F.col(c))) for c in names], F.lit(""))


def map_generic(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(audio_filepath, text) of rows that have a path."""
    return df.select(*(keep or []), audio_path(df).alias("audio_filepath"), transcript(df).alias("text")).where("audio_filepath is not null")


def map_common_voice(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """As map_generic, but a sentence that isn't empty is taken as it stands."""
    own = blank_to_null(F.col("sentence")) if "sentence" in df.columns else F.lit(None).cast("string")
    return df.select(*(keep or []), audio_path(df).alias("audio_filepath"), F.coalesce(own, transcript(df)).alias("text")).where("audio_filepath is not null")


def map_custom(df: DataFrame, audio: str, words: str, keep: list[str] | None = None) -> DataFrame:
    """Named columns; without them no rows. Other types become strings, null an empty text."""
    if audio not in df.columns or words not in df.columns:
        return df.select(*(keep or []), F.lit(None).cast("string").alias("audio_filepath"), F.lit(None).cast("string").alias("text")).limit(0)
    return df.select(*(keep or []), audio_path(df, [audio]).alias("audio_filepath"), F.coalesce(strip(F.col(words).cast("string")), F.lit("")).alias("text")).where("audio_filepath is not null")


def choose_mapper(name: str, forced: str | None = None):
    return {"generic": map_generic, "common_voice": map_common_voice}[forced] if forced else map_common_voice if "common_voice" in name.lower() else map_generic


def detect_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """The audio and text columns of a cached table, by name."""
    return next((c for c in CACHE_AUDIO if c in df.columns), None), next((c for c in CACHE_TEXT if c in df.columns), None)


def normalize_repo_id(x: Column) -> Column:
    """a___b is a/b, unless there is a slash already."""
    return F.when(~F.contains(x, F.lit("/")), F.replace(x, F.lit("___"), F.lit("/"))).otherwise(x)


def attach_constants(df: DataFrame, source_lang: str = "ru", target_lang: str = "ru", pnc: str = "yes") -> DataFrame:
    return df.withColumns({"source_lang": F.lit(source_lang), "target_lang": F.lit(target_lang), "pnc": F.lit(pnc)})


def guess_split(path: Column) -> Column:
    """train, validation or test, from the last part of a path that names one; null where none does. A part that contains the word counts."""
    parts = F.reverse(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"))
    name = lambda p: F.when(p.contains("train"), "train").when(p.rlike("validation|valid|dev"), "validation").when(p.contains("test"), "test")
    return F.get(F.filter(F.transform(parts, name), lambda x: x.isNotNull()), F.lit(0))


def resolve_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def is_audio(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(wav|flac|mp3)$")


def drop_empty(df: DataFrame) -> DataFrame:
    return df.where(F.col("audio_filepath").isNotNull() & (strip(F.coalesce("text", F.lit(""))) != ""))


def duration_filter(df: DataFrame, low: float | None, high: float | None, null_passes: bool = True) -> DataFrame:
    """Durations within inclusive bounds. An unknown duration passes in building and drops in quality filtering."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col("duration") >= low)
    if high is not None:
        ok = ok & (F.col("duration") <= high)
    unknown = F.col("duration").isNull()
    return df.where(unknown | ok if null_passes else ~unknown & ok)


def build_counters(df: DataFrame, low: float, high: float) -> DataFrame:
    """Rows written, skipped as empty, and skipped by duration, in one pass."""
    empty = strip(F.coalesce("text", F.lit(""))) == ""
    out = ~empty & F.col("duration").isNotNull() & ~F.col("duration").between(low, high)
    return df.agg(F.count_if(~empty & ~out).alias("written"), F.count_if(empty).alias("skipped_empty"), F.count_if(out).alias("skipped_dur"))


def quality_filter(manifest: DataFrame, preds: DataFrame, max_wer: float = 0.15, low: float = 1.0, high: float = 35.0) -> DataFrame:
    """Rows whose duration is known and within bounds and whose prediction, as it stands, is within the error rate. Cheap conditions come before the alignment."""
    ship_code(manifest.sparkSession)
    rows = duration_filter(manifest, low, high, null_passes=False).where(F.coalesce("text", F.lit("")) != "")
    both = rows.join(preds.where(F.coalesce("pred_text", F.lit("")) != ""), "audio_filepath")
    c = alignment.edit_counts(text.tokens(F.col("text")), text.tokens(F.col("pred_text")))
    scored = both.withColumn("_c", c).withColumn("wer", F.round((F.col("_c.sub") + F.col("_c.ins") + F.col("_c.del")) / F.greatest(F.lit(1), F.col("_c.n_ref")), 6)).drop("_c")
    return scored.where(F.col("wer") <= max_wer)


def missing_audio(manifest: DataFrame, files: DataFrame, home: str = os.path.expanduser("~")) -> DataFrame:
    """Rows whose file isn't listed, tried as it stands, with forward slashes, and with a leading ~ as the home folder. files: (path)."""
    slashes = F.replace("audio_filepath", F.lit("\\"), F.lit("/"))
    at_home = F.when(slashes.rlike("^~(/|$)"), F.concat(F.lit(home.rstrip("/")), F.substring(slashes, 2, 1 << 20))).otherwise(slashes)
    tried = manifest.withColumn("_p", F.explode(F.array_distinct(F.array("audio_filepath", slashes, at_home))))
    found = tried.join(files.select(F.col("path").alias("_p")), "_p", "left_semi").select("audio_filepath").distinct()
    return manifest.join(found, "audio_filepath", "left_anti")


def pack_rename(manifest: DataFrame, order: str, existing: DataFrame | None = None) -> DataFrame:
    """manifest with ``packed_name``, unique: the file's own name where it is free when its row comes, else the first free one of stem_0001.ext and so on. existing: (name) of files that are in the folder already."""
    return naming.unique_names(manifest, "audio_filepath", order, "packed_name", existing)


def cut_manifest(manifest: DataFrame, order: str, base: str = "") -> DataFrame:
    """One cut for each row with a known duration: recording r%08d from 1 on, one supervision."""
    fill = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in manifest.columns else F.lit(v)
    rows = row_numbers(manifest, [F.col(order)])
    rec = F.format_string("r%08d", "rn")
    custom = F.struct(fill("source_lang", "ru").alias("source_lang"), fill("target_lang", "ru").alias("target_lang"), fill("pnc", "yes").alias("pnc"))
    sup = F.struct(F.concat(rec, F.lit("-0")).alias("id"), rec.alias("recording_id"), F.lit(0.0).alias("start"), F.col("duration"), F.lit(0).alias("channel"), fill("text", "").alias("text"), fill("target_lang", "ru").alias("language"), custom.alias("custom"))
    path = resolve_path(F.col("audio_filepath"), base) if base else F.col("audio_filepath")
    return rows.select(rec.alias("recording_id"), path.alias("audio_filepath"), F.col("duration"), sup.alias("supervision"))


def hypothesis_text(df: DataFrame) -> Column:
    """The text of a hypothesis row: text, pred_text or transcription, else the first string column."""
    names = [c for c in ("text", "pred_text", "transcription") if c in df.columns]
    names += [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in names][:1]
    return F.coalesce(*[F.col(c) for c in names]) if names else F.lit(None).cast("string")


def sliding_chunks(rows: DataFrame, window: float = 15.0, hop: float = 14.0) -> DataFrame:
    """A row for each window that starts before the end: idx, start, end."""
    last = F.greatest(F.ceil(F.col("duration") / hop) - 1, F.lit(0)).cast("int")
    each = rows.where("duration > 0").withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
    return each.withColumn("start", F.col("idx") * F.lit(hop)).withColumn("end", F.least(F.col("start") + window, F.col("duration")))


def join_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Texts of windows joined in their order. chunks: (key, idx, text)."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return chunks.where("text is not null and text <> ''").groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def pad_and_mask(df: DataFrame, column: str, length: int, pad: int = -100) -> DataFrame:
    """Label lists cut or padded to one length."""
    c = F.slice(column, 1, length)
    return df.withColumn(column, F.concat(c, F.array_repeat(F.lit(pad).cast("int"), F.lit(length) - F.size(c))))
