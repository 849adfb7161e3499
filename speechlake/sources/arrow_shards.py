"""A source for cached Arrow shards: a partition for each range of record batches, whatever a shard's size.

A shard is an Arrow stream or file. Its messages are walked by their headers alone, which say how long their bodies are,
and cut into ranges of about ``rangeBytes``; a task reads the schema, the dictionaries before its range, and its
range. Only the wanted columns leave a task, and a wanted split, given as an
option or, with ``pushFilters``, by a filter, leaves out shards before any is opened. Reads go
through Arrow's file systems, so shards lie in local or shared folders or in a store that Arrow reaches.

    spark.dataSource.register(ArrowShards)
    spark.read.format("arrow_shards").option("columns", "path,text").load("/data/cache")

Options: ``columns`` (all, if not given, of the first shard's; a shard that lacks one gives nulls), ``split`` (only shards whose
path names it), ``rangeBytes``, ``pushFilters`` (true where spark.sql.python.filterPushdown.enabled is). Every row has a ``split`` too, null where a path names none. Defined results: folders
without shards have no rows and a schema of ``split`` alone; a broken shard is an error; dictionaries come out as their values.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

RANGE_BYTES = 64 << 20
#: Kinds of messages.
_SCHEMA, _DICTIONARY, _BATCH = 1, 2, 3


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    plain = path.removeprefix("file://").removeprefix("file:")
    return pa.fs.FileSystem.from_uri(plain) if "://" in plain else (pa.fs.LocalFileSystem(), plain)


def split_named(path: str) -> str | None:
    """The split that a shard's path names, as manifests.guess_split says it."""
    for part in reversed(path.lower().replace("\\", "/").split("/")):
        for split, names in (("train", ("train",)), ("validation", ("valid", "dev")), ("test", ("test",))):
            if any(n in part for n in names):
                return split
    return None


def _field(meta: bytes, table: int, k: int) -> int | None:
    """Where field k of a flatbuffer table lies; None where it has its default."""
    vtable = table - struct.unpack_from("<i", meta, table)[0]
    if 4 + 2 * k >= struct.unpack_from("<H", meta, vtable)[0]:
        return None
    off = struct.unpack_from("<H", meta, vtable + 4 + 2 * k)[0]
    return table + off if off else None


def _message(meta: bytes) -> tuple[int, int]:
    """(kind, bytes of the body) of a message's metadata."""
    table = struct.unpack_from("<I", meta)[0]
    kind, body = _field(meta, table, 1), _field(meta, table, 3)
    return meta[kind] if kind is not None else 0, struct.unpack_from("<q", meta, body)[0] if body is not None else 0


def messages(file: pa.NativeFile) -> Iterator[tuple[int, int, int]]:
    """(kind, offset, whole length) of a shard's messages, by their headers."""
    size = file.size()
    at = 8 if file.read_at(6, 0) == b"ARROW1" else 0  # the file format frames a stream
    while at + 8 <= size:
        head = file.read_at(8, at)
        mark, length = struct.unpack("<Ii", head)
        prefix = 8
        if mark != 0xFFFFFFFF:  # before version 0.15 there was no mark
            length, prefix = mark, 4
        if length == 0:
            return
        if length < 0 or at + prefix + length > size:
            raise ValueError("broken shard: a message ends behind the file")
        kind, body = _message(file.read_at(length, at + prefix))
        whole = prefix + length + body
        if body < 0 or at + whole > size:
            raise ValueError("broken shard: a body ends behind the file")
        yield kind, at, whole
        at += whole


def ranges(path: str, most: int) -> list[list[tuple[int, int]]]:
    """Parts of a shard: byte ranges of the schema, the dictionaries so far and a run of batches of about ``most`` bytes."""
    store, name = store_of(path)
    with store.open_input_file(name) as file:
        lead: list[tuple[int, int]] = []
        out, held = [], []
        for kind, at, n in messages(file):
            if kind in (_SCHEMA, _DICTIONARY):
                if held:
                    out.append([*lead, *held])
                    held = []
                lead.append((at, n))
            elif kind == _BATCH:
                held.append((at, n))
                if sum(x for _, x in held) >= most:
                    out.append([*lead, *held])
                    held = []
        return [*out, [*lead, *held]] if held else out


def read_range(path: str, parts: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The batches of a part, one in memory at a time."""
    store, name = store_of(path)
    with store.open_input_file(name) as file:

        class Joined(io.RawIOBase):
            """The byte ranges, one behind another."""

            def __init__(self):
                self.todo, self.now, self.at = list(parts), b"", 0

            def readable(self) -> bool:
                return True

            def readinto(self, b) -> int:
                if self.at == len(self.now):
                    if not self.todo:
                        return 0
                    at, n = self.todo.pop(0)
                    step = min(n, 8 << 20)
                    self.now, self.at = file.read_at(step, at), 0
                    if n > step:
                        self.todo.insert(0, (at + step, n - step))
                n = min(len(b), len(self.now) - self.at)
                b[:n] = self.now[self.at : self.at + n]
                self.at += n
                return n

        yield from pa.ipc.open_stream(io.BufferedReader(Joined()))


def shards_below(folder: str) -> list[str]:
    store, root = store_of(folder)
    prefix = folder[: len(folder) - len(root)] if folder.endswith(root) and "://" in folder else ""
    info = store.get_file_info(root)
    if info.type == pa.fs.FileType.File:
        return [folder]
    return sorted(prefix + f.path for f in store.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".arrow"))


def _plain(kind: pa.DataType) -> pa.DataType:
    return kind.value_type if pa.types.is_dictionary(kind) else kind


class Part(InputPartition):
    def __init__(self, path: str, parts: list[tuple[int, int]]):
        super().__init__((path, parts))
        self.path, self.parts = path, parts


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.folder, self.most = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.split = options.get("split")
        self.kinds = {f.name: _plain(f.type) for f in ArrowShards(options).arrow_fields()}

    def partitions(self) -> list[Part]:
        shards = [p for p in shards_below(self.folder) if self.split is None or split_named(p[len(self.folder) :]) == self.split]
        return [Part(p, r) for p in shards for r in ranges(p, self.most)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Part):  # a folder without shards has one empty partition
            return
        split = split_named(partition.path[len(self.folder) :])
        for batch in read_range(partition.path, partition.parts):
            columns = []
            for name in self.names:
                if name == "split":
                    columns.append(pa.array([split] * batch.num_rows, pa.string()))
                elif name in batch.schema.names:
                    columns.append(batch.column(name).cast(self.kinds[name]))
                else:
                    columns.append(pa.nulls(batch.num_rows, self.kinds[name]))
            yield pa.RecordBatch.from_arrays(columns, self.names)


class FilteringReader(Reader):
    """For sessions with spark.sql.python.filterPushdown.enabled, without which Spark refuses a reader that takes filters."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("split",) and self.split in (None, f.value):
                self.split = f.value
            else:
                yield f


class ArrowShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def arrow_fields(self) -> list[pa.Field]:
        """The wanted fields of the first shard, in the order asked for."""
        shards = shards_below(self.options["path"])
        if not shards:
            return []
        store, name = store_of(shards[0])
        with store.open_input_file(name) as file:
            kind, at, n = next(messages(file))
            schema = pa.ipc.open_stream(file.read_at(n, at) + b"\xff\xff\xff\xff\0\0\0\0").schema
        known = {f.name: f for f in schema}
        wanted = [c.strip() for c in self.options.get("columns", ",".join(known)).split(",")]
        missing = [c for c in wanted if c not in known]
        if missing:
            raise ValueError(f"no columns {missing} in {shards[0]}")
        return [pa.field(c, _plain(known[c].type)) for c in wanted if c != "split"]

    def schema(self) -> StructType:
        fields = from_arrow_schema(pa.schema(self.arrow_fields())).fields
        return StructType([StructField(f.name, f.dataType, True) for f in fields] + [StructField("split", StringType(), True)])

    def reader(self, schema: StructType) -> Reader:
        kind = FilteringReader if self.options.get("pushfilters", "false").lower() == "true" else Reader
        return kind(schema, dict(self.options))
