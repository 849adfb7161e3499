"""Shared plumbing of the corpus operators: byte-level text chunks, hashing, packed rows and shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import secrets
import struct
import tempfile
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.session import ship_code

#: Bytes of text that a Python worker turns into NumPy arrays at once.
CHUNK_BYTES = 1 << 20
_U = np.uint64


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch between the JVM and a Python worker holds; give the workers this package."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def trim() -> None:
    """Give memory that an idle worker would keep back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, a function of batches, with trim() at the end of each task."""

    @functools.wraps(run)
    def lean_run(batches):
        yield from run(batches)
        trim()

    return lean_run


def n_buckets(spark: SparkSession) -> int:
    """Buckets of a distributed pass: as many as shuffle partitions, which a deployment sizes with its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder set on the context, or on a local master (tests) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="speechlake-")
        spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/speechlake-{uuid.uuid4().hex}/{name}"


def checkpointed(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """An eager checkpoint in the shared folder. keep_partitioning: later joins on the same keys need no new exchange."""
    spark = df.sparkSession
    shared_dir(spark)
    if not keep_partitioning:
        return df.checkpoint()
    with without_aqe(spark):
        return df.checkpoint()


@contextlib.contextmanager
def without_aqe(spark: SparkSession):
    """Adaptive plans don't tell how their output is partitioned; a plan made in here does."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


#: Most ids that are broadcast (8 bytes each); share of all rows from which a class is frequent, so that there are fewer frequent classes than this.
BROADCAST_IDS, FREQUENT = 1_000_000, 1000


def ids_if_small(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if their number allows it."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], values: list[str], spread: Column) -> DataFrame:
    """rows with the ``values`` of their class, null where they have none. classes, a written table: keys (longs, as in rows), copies, values.

    Classes with over one in FREQUENT of all copies are broadcast; other rows meet their classes in a shuffle, where rows
    without a class, by a null first key or an unknown one, are dealt by ``spread``.
    """
    total = classes.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * FREQUENT > total
    few = classes.where(often).select(*[F.col(k).alias(f"_few_{k}") for k in keys], *[F.col(v).alias(f"_few_of_{v}") for v in values], F.lit(True).alias("_few"))
    out = rows.join(F.broadcast(few), [F.col(k) == F.col(f"_few_{k}") for k in keys], "left")
    done = F.col("_few").isNotNull() | F.col(keys[0]).isNull()
    asks = [F.when(done, spread if i == 0 else None).otherwise(F.col(k)).alias(f"_ask_{k}") for i, k in enumerate(keys)]
    rest = classes.where(~often).select(*[F.col(k).alias(f"_rest_{k}") for k in keys], *[F.col(v).alias(f"_rest_of_{v}") for v in values])
    both = out.select("*", *asks).join(rest, [F.col(f"_ask_{k}") == F.col(f"_rest_{k}") for k in keys], "left")
    return both.select(*rows.columns, *[F.coalesce(f"_few_of_{v}", F.when(~done, F.col(f"_rest_of_{v}"))).alias(v) for v in values])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- texts as bytes


def text_chunks(batch: pa.RecordBatch, id_col: int = 0, text_col: int = 1, limit: int = CHUNK_BYTES):
    """(ids, offsets, bytes) of slices of a batch with about ``limit`` bytes of text each; a null text is empty. ids are an Arrow array where some are null."""
    ids = np.arange(batch.num_rows) if id_col == text_col else batch.column(id_col)
    if isinstance(ids, pa.Array) and not ids.null_count:
        ids = ids.to_numpy(zero_copy_only=False)
    col = batch.column(text_col)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_utf8()) if not pa.types.is_large_string(col.type) else col
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at, n = 0, len(col)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield ids[at:to], offs[at : to + 1] - offs[at], data[offs[at] : offs[to]]
        at = to


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that lie between document borders, and how many runs each document has."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    first = np.empty(n, bool)
    first[0] = mask[0]
    first[1:] = mask[1:] & ~mask[:-1]
    last = np.empty(n, bool)
    last[-1] = mask[-1]
    last[:-1] = mask[:-1] & ~mask[1:]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


# ---------------------------------------------------------------- hashes (64 bit, wrapping)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if base not in _POW or len(_POW[base][0]) < n + 1:
        size, found = max(n + 1, CHUNK_BYTES + 1), []
        with np.errstate(over="ignore"):
            for b in (base, pow(base, -1, 1 << 64)):
                a = np.full(size, b, _U)
                a[0] = 1
                found.append(np.multiply.accumulate(a))
        _POW[base] = tuple(found)
    return _POW[base]


class RangeHash:
    """Hashes of any byte ranges of a buffer, each in constant time: equal ranges have equal hashes.

    For ranges of a few hundred bytes: modulo a power of two, words of a thousand letters can be made that differ and
    have equal hashes whatever the base. Words and whole texts are told by word_hashes and digest64.
    """

    def __init__(self, data: np.ndarray, base: int = _BASE):
        p, self.inv = _powers(len(data), base)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * p[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inv[starts]
        return mix64(h + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def digest64(values) -> np.ndarray:
    """64 bits of a cryptographic hash of each byte string."""
    return np.frombuffer(b"".join([blake2b(v, digest_size=8).digest() for v in values]), _U)


#: Masks of the lowest k bytes.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(8)], _U)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, given as ranges that ascend and don't overlap: mixed bytes and length of words up to seven bytes, which no two share, digest64 of longer ones."""
    lens = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(padded[:8].view(_U), (len(data) + 1,), (1,))
    short = np.minimum(lens, 7)
    out = mix64((windows[starts] & _LOWEST[short]) | (short.astype(_U) << _U(56)))
    long = np.flatnonzero(lens > 7)
    if len(long):
        borders = np.column_stack([starts[long], ends[long]]).astype(np.int64).ravel()
        coded = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(padded)]).dictionary_encode()
        index = coded.indices.to_numpy()[::2]
        used = np.zeros(len(coded.dictionary), bool)
        used[index] = True
        out[long] = digest64(coded.dictionary.filter(pa.array(used)).to_pylist())[(np.cumsum(used) - 1)[index]]
    return out


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix64(np.asarray(ids).astype(np.int64).view(_U)) % _U(n)).astype(np.int32)


# ---------------------------------------------------------------- words and what is known of them

_SPACE, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_POINT[list(b"!#$%&*,.:;?|")] = True


def cut_pieces(offs: np.ndarray, data: np.ndarray, fine: bool = True):
    """(borders of all pieces, distinct pieces, which one each piece is, a key of this process for each distinct piece) of a buffer that isn't empty.

    Pieces end behind ASCII white space, which they take along, and at document borders; fine: also between an
    ASCII letter and ASCII punctuation, and A-Z become a-z.
    """
    n, space = len(data), _SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[1:] = space
    begins[1:-1] &= ~space[1:]
    if fine:
        data = LOWER[data]
        begins[1:-1] |= _POINT[data[1:]] & (data[:-1] >= 97) & (data[:-1] <= 122)
    begins[offs] = True
    begins[n] = True
    cuts = np.flatnonzero(begins)
    coded = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    words = coded.dictionary
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
    return cuts, words, coded.indices.to_numpy(), _private_keys(np.frombuffer(words.buffers()[2], np.uint8, int(at[-1])), at.astype(np.int64))


#: Bytes of a piece up to which a polynomial with a base that nobody knows tells it from all others.
_SHORT = 32
_PRIVATE: list[int] = []


def _private_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of each piece between the borders, for this process alone: by a base drawn for it where a piece is short, else by a cryptographic hash. No text can be made that two pieces share one."""
    if not _PRIVATE:
        _PRIVATE.append(secrets.randbits(64) | 1)
    keys = RangeHash(data, _PRIVATE[0])(at[:-1], at[1:])
    long = np.flatnonzero(np.diff(at) > _SHORT)
    if len(long):
        keys[long] = digest64([data[a:z].tobytes() for a, z in zip(at[long].tolist(), at[long + 1].tolist(), strict=True)])
    return keys


class HashIndex:
    """Slots by 64-bit hash in a few sorted runs, each at least twice the next."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for known, slots in self.runs:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Give distinct new keys the next slots, in their order."""
        order = np.argsort(keys)
        self.runs.append((keys[order], (order + self.size).astype(np.int32)))
        self.size += len(keys)
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            (k1, s1), (k2, s2) = self.runs.pop(), self.runs.pop()
            k, s = np.concatenate([k1, k2]), np.concatenate([s1, s2])
            order = np.argsort(k, kind="stable")
            self.runs.append((k[order], s[order]))


# ---------------------------------------------------------------- packed rows


def pack(*arrays: np.ndarray | bytes, level: int | None = 1) -> bytes:
    """Arrays as one binary value; level None leaves it uncompressed."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    raw = struct.pack("<I", len(parts)) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)
    return b"\0" + raw if level is None else b"\1" + zstandard.ZstdCompressor(level=level).compress(raw)


def unpack(blob: bytes, *dtypes) -> list:
    """What pack() made; a dtype of bytes gives the bytes."""
    raw = blob[1:] if blob[:1] == b"\0" else zstandard.ZstdDecompressor().decompress(blob[1:])
    (n,) = struct.unpack_from("<I", raw)
    lens, at, out = struct.unpack_from(f"<{n}Q", raw, 4), 4 + 8 * n, []
    for size, kind in zip(lens, dtypes, strict=True):
        out.append(raw[at : at + size] if kind is bytes else np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def groups_of(keys: np.ndarray):
    """(key, positions) for each distinct key; positions ascend."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(k)], strict=True):
        yield int(k[a]), order[a:b]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)
