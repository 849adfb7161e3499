"""The contract for speech models: batches of audio in, texts out; models are plugged in.

A model is loaded once for each Python worker and sees whole Arrow batches; Spark's partitions take the place of
worker processes and its resource scheduling the place of device locks.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions import audio_headers, features, signal
from speechlake.session import ship_code

#: Clips of a batch by model family; others take the last.
BATCH = {"large-v3": 24, "turbo": 64, "distil": 64, "": 16}


def batch_size(model: str) -> int:
    return next(n for name, n in BATCH.items() if name in model)


def recognize_speech(audio: DataFrame, load: Callable[[], Callable[..., list[str]]], key: str = "audio_filepath", content: str = "content", size: int = 16, arguments: tuple[str, ...] = (), profile: ResourceProfile | None = None) -> DataFrame:
    """(key, hyp) of every row. load() gives a function from a list of contents to as many texts; it is called once for each task.

    arguments: columns (languages, task, punctuation) whose values the function gets too, as a list of dictionaries.
    profile: what a task of this stage needs (model_resources), where that differs from other stages'. There is no barrier:
    a task that is lost runs again by itself, and only its batches do.
    """
    ship_code(audio.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            texts: list[str] = []
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                more = [part[list(arguments)].to_dict("records")] if arguments else []
                texts += model(part[content].tolist(), *more)
            yield pd.DataFrame({key: batch[key], "hyp": texts})

    return audio.select(key, content, *arguments).mapInPandas(run, f"{key} string, hyp string", profile=profile)


def model_resources(spark: SparkSession, gpus: float = 1, cpus: int = 1, executor_cores: int | None = None, memory: str | None = None, script: str = "") -> ResourceProfile | None:
    """What a stage that runs a model asks for: devices and cores of a task, and where given cores, memory and devices of an executor of its own (with dynamic allocation). None on a local master, which can't have them."""
    if spark.sparkContext.master.startswith("local"):
        return None
    return resource_profile(gpus, cpus, executor_cores, memory, script)


def resource_profile(gpus: float, cpus: int, executor_cores: int | None, memory: str | None, script: str) -> ResourceProfile:
    task = TaskResourceRequests().cpus(cpus)
    if gpus:
        task = task.resource("gpu", gpus)
    builder = ResourceProfileBuilder().require(task)
    if executor_cores or memory:
        executor = ExecutorResourceRequests()
        if executor_cores:
            executor = executor.cores(executor_cores)
        if memory:
            executor = executor.memory(memory)
        if gpus:
            executor = executor.resource("gpu", max(1, round(gpus * (executor_cores or cpus) / cpus)), script)
        builder = builder.require(executor)
    return builder.build


def recognize_long(audio: DataFrame, load: Callable[[], Callable[[list], list[str]]], key: str = "audio_filepath", content: str = "content", window: float = 15.0, hop: float = 14.0) -> DataFrame:
    """(key, hyp) of WAV recordings of any length: mixed down to one channel, cut into windows, each recognized as a clip of its own, the texts joined in their order. Audio that can't be read has an empty text.

    Windows of a recording are recognized where it was read, so nothing is shuffled.
    """
    ship_code(audio.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            texts = [" ".join(t for clip in wav_windows(x, window, hop) if (t := model([clip])[0])).strip() for x in batch[content]]
            yield pd.DataFrame({key: batch[key], "hyp": texts})

    return audio.select(key, content).mapInPandas(run, f"{key} string, hyp string")


def wav_windows(content: bytes | None, window: float = 15.0, hop: float = 14.0) -> Iterator[bytes]:
    """WAV clips of ``window`` seconds, one each ``hop`` seconds up to the end, mixed down to the mean of the channels."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            channels, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return
    if width == 3:  # 24 bits: the low byte of 32
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        samples, width = wide.view("<i4").ravel(), 4
    else:
        samples = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width])
    mono = samples.reshape(-1, channels).mean(axis=1).round().astype(samples.dtype)
    size, step = max(1, int(window * rate)), max(1, int(hop * rate))
    for at in range(0, len(mono), step):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, width, rate, 0, "NONE", ""))
            w.writeframes(mono[at : at + size].tobytes())
        yield out.getvalue()


def with_fallback(first: Callable[[list], list[str]], second: Callable[[list], list[str]]) -> Callable[[list], list[str]]:
    """Long audio: what the first model refuses goes to the second, clip by clip."""

    def run(batch: list) -> list[str]:
        try:
            return first(batch)
        except Exception:  # noqa: BLE001  a model's own errors
            return [second([x])[0] for x in batch]

    return run


def audio_seconds(content: bytes | None) -> float | None:
    """Length of a WAV, FLAC or MP3 file from its headers; None where they don't tell."""
    return audio_headers.seconds(audio_headers.of_bytes(content)) if content else None


#: The same by the name that says what most files are.
wav_seconds = audio_seconds


def with_durations(files: DataFrame, content: str = "content") -> DataFrame:
    @F.pandas_udf("double")
    def seconds(x: pd.Series) -> pd.Series:
        return x.map(audio_seconds).astype("float64")

    ship_code(files.sparkSession)
    return files.withColumn("duration", F.when(F.isnan(seconds(F.col(content))), None).otherwise(seconds(F.col(content))))


def named_durations(named: DataFrame) -> DataFrame:
    """(audio_filepath, duration, bytes_read) of the files that the rows (path) name: only their headers are read, where the rows are. A file that can't be read has no duration."""
    ship_code(named.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lengths, seen = batch.column(0).to_pylist(), [], []
            for p in paths:
                try:
                    plain = p.removeprefix("file://").removeprefix("file:")
                    store, name = pa.fs.FileSystem.from_uri(plain) if "://" in plain else (pa.fs.LocalFileSystem(), plain)
                    with store.open_input_file(name) as f:
                        file = audio_headers.Ranges(lambda at, n, f=f: f.read_at(n, at), f.size())
                        lengths.append(audio_headers.seconds(file))
                        seen.append(file.seen)
                except (OSError, ValueError):
                    lengths.append(None)
                    seen.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.float64()), pa.array(seen, pa.int64())], ["audio_filepath", "duration", "bytes_read"])

    return named.where("path is not null").select("path").mapInArrow(run, "audio_filepath string, duration double, bytes_read long")


def with_signal(files: DataFrame, content: str = "content") -> DataFrame:
    """files with duration, level_db, speech_seconds and snr_db of their WAV content; null where signal.measure says None."""
    ship_code(files.sparkSession)
    kept = [c for c in files.columns if c != content]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signal.measure(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array([f[k] for f in found], pa.float64()) for k in range(4)]], [*kept, "duration", "level_db", "speech_seconds", "snr_db"])

    return files.select(*kept, content).mapInArrow(run, kinds + "duration double, level_db double, speech_seconds double, snr_db double")


def with_features(files: DataFrame, content: str = "content", seconds: float | None = 30.0) -> DataFrame:
    """files with n_samples at 16 kHz and features, a list of frames for each mel band, of their WAV content cut or filled to so many seconds; null where it can't be read."""
    ship_code(files.sparkSession)
    kept = [c for c in files.columns if c != content]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.select(*kept).schema)

    def one(raw: bytes | None) -> tuple[int | None, list | None]:
        try:
            rate, blocks = signal.samples_of(raw or b"")
            x = np.concatenate([np.zeros(0), *blocks])
        except (wave.Error, EOFError, ValueError, ZeroDivisionError):
            return None, None
        return -(-len(x) * features.RATE // rate), features.clip_features(x, rate, seconds).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(len(kept)).to_pylist()):  # a clip's features are a row of some size
                n, found = one(raw)
                yield pa.RecordBatch.from_arrays([*[c.slice(k, 1) for c in batch.columns[: len(kept)]], pa.array([n], pa.int64()), pa.array([found], pa.list_(pa.list_(pa.float32())))], [*kept, "n_samples", "features"])

    return files.select(*kept, content).mapInArrow(run, kinds + "n_samples long, features array<array<float>>")


def signal_filter(measured: DataFrame, least_snr: float = 5.0, least_level: float = -60.0, least_speech: float = 0.0) -> DataFrame:
    """Rows of with_signal whose ratio, level and speech reach the limits; what could not be measured drops. (Described in the domain's methodology, an extension.)"""
    return measured.where((F.col("snr_db") >= least_snr) & (F.col("level_db") >= least_level) & (F.col("speech_seconds") >= least_speech))


def recognize_names(texts: DataFrame, column: str, model: Callable[[list[str]], list[list[str]]] | None = None) -> DataFrame:
    """texts with ``entities``: the plugged model's, or capitalized words where there is none or it finds none."""
    from speechlake.functions.text import capitalized_tokens

    plain = F.transform(capitalized_tokens(F.col(column)), lambda t: F.struct(t.alias("text"), F.lit("PER?").alias("kind")))
    if model is None:
        return texts.withColumn("entities", plain)

    @F.pandas_udf("array<string>")
    def found(x: pd.Series) -> pd.Series:
        return pd.Series(model(x.fillna("").tolist()))

    named = F.transform(found(F.col(column)), lambda t: F.struct(t.alias("text"), F.lit("NAME").alias("kind")))
    return texts.withColumn("entities", F.when(F.size(named) > 0, named).otherwise(plain))
