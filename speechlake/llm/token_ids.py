"""Token ids in directly addressable codes.

``encode_documents`` tokenizes whole texts, ``DacImage`` is the file format (chunk levels, continuation
bitmaps, rank directories; any token is read without decoding a block), ``write_token_files`` writes images in
ascending id order and ``read_token_files`` reads them back.

Defined results: a null text is an empty text; an empty text has the end id only; repeated rows are kept, each
with its own place, and rows that share a doc_id lie in the order of their ids' bytes, so that a second run writes the
same; rows without a doc_id have no place in the order and aren't written; an empty table gives no files and no rows;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.llm.common import HashIndex, cut_pieces, lean, n_buckets, ragged, text_chunks, tune, work_path

#: Tokens that one image holds, about.
IMAGE_TOKENS = 1 << 17
#: Bits between entries of a rank directory.
RANK_BITS = 512
_MAGIC = b"DACT"
#: Bytes of text encoded at once.
ENCODE_BYTES = 1 << 20


class DacImage:
    """Ids split into chunks of ``chunk_bits``; level k holds the k-th chunk of those ids that have one.

    Layout, little-endian: magic, u8 chunk bits, u8 levels, u16 zero, u32 documents, u64 tokens; doc ids (i64),
    document starts (u64, one more than documents); then for each level u64 count, chunks (u8 or u16),
    continuation bitmap and rank directory (u32 for each RANK_BITS bits: ones before).
    """

    def __init__(self, buf: bytes):
        magic, self.bits, n_levels, _, docs, self.n = struct.unpack_from("<4sBBHIQ", buf)
        if magic != _MAGIC:
            raise ValueError("not a token image")
        at = struct.calcsize("<4sBBHIQ")

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(buf, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.starts, self.levels = take("<i8", docs), take("<u8", docs + 1).astype(np.int64), []
        for _ in range(n_levels):
            count = int(take("<u8", 1)[0])
            chunks = take("u1" if self.bits <= 8 else "<u2", count)
            bitmap = take("u1", (count + 7) // 8)
            self.levels.append((chunks, bitmap, take("<u4", (count + RANK_BITS - 1) // RANK_BITS)))

    @staticmethod
    def build(doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray, chunk_bits: int = 8) -> bytes:
        starts = np.zeros(len(lens) + 1, "<u8")
        np.cumsum(lens, out=starts[1:])
        rest, levels = ids.astype(np.uint32), []
        while True:
            chunk, rest = rest & ((1 << chunk_bits) - 1), rest >> chunk_bits
            goes_on = rest > 0
            marks = np.concatenate([goes_on, np.zeros(-len(goes_on) % RANK_BITS, bool)])
            ones = marks.reshape(-1, RANK_BITS).sum(1)
            rank = (np.cumsum(ones) - ones).astype("<u4")
            levels.append(np.uint64(len(chunk)).tobytes() + chunk.astype("u1" if chunk_bits <= 8 else "<u2").tobytes() + np.packbits(goes_on, bitorder="little").tobytes() + rank.tobytes())
            rest = rest[goes_on]
            if not len(rest):
                break
        head = struct.pack("<4sBBHIQ", _MAGIC, chunk_bits, len(levels), 0, len(doc_ids), len(ids))
        return head + np.asarray(doc_ids, "<i8").tobytes() + starts.tobytes() + b"".join(levels)

    def __getitem__(self, i: int) -> int:
        """Token i, by rank alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, rank in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            bits = np.unpackbits(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i, shift = int(rank[block]) + int(bits.sum()), shift + self.bits
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        out, where = np.zeros(self.n, np.uint32), np.arange(self.n)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(k * self.bits)
            where = where[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, each read by its own address."""
        return np.array([self[i] for i in range(self.starts[k], self.starts[k + 1])], np.uint32)


def _plain(x: str) -> bool:
    """Whether the tokenizer's steps before its merges leave this as one word: lower-case composed letters up to U+017F."""
    return x.isalpha() and (x.isascii() or max(x) < "\u0180") and x == x.lower()


def _byte_chars() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


class PieceEncoder:
    """Encodes texts piece by piece; pieces seen before are looked up.

    Pieces end at ASCII white space, which the tokenizer drops, and between an ASCII letter and ASCII
    punctuation, where it always splits; A-Z become a-z first, as it does. A chunk that may hold the text of a
    special token is cut at white space alone and keeps its letters.
    """

    #: Pieces given to the tokenizer at once.
    STEP = 8192

    def __init__(self, vocabulary: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(vocabulary), most
        self._reset()

    def _reset(self):
        self.known = HashIndex()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.len = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)

    def _add(self, new: pa.Array):
        for at in range(0, len(new), self.STEP):
            texts, one = [x.decode("utf-8").rstrip("\t\n\r ") for x in new.slice(at, self.STEP).to_pylist()], self.tokenizer.model.tokenize
            lists = [[t.id for t in one(x)] if x.isascii() and x.isalpha() and x.islower() else [t.id for t in one("".join([_BYTE_CHARS[b] for b in x.encode()]))] if _plain(x) else None for x in texts]
            rest = [k for k, x in enumerate(lists) if x is None]
            for k, e in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
                lists[k] = e.ids
            lens = np.fromiter(map(len, lists), np.int32, len(lists))
            need, k = self.used + int(lens.sum()), self.added
            while need > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while k + len(lists) > len(self.begin):
                self.begin, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.len))
            self.flat[self.used : need] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, need - self.used)
            self.begin[k : k + len(lists)], self.len[k : k + len(lists)] = self.used + np.cumsum(lens) - lens, lens
            self.used, self.added = need, k + len(lists)

    def __call__(self, offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, how many each has)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        cuts, words, index, keys = cut_pieces(offs, data, fine=not ((data[:-1] == 60) & (data[1:] == 124)).any())  # no "<|"
        if self.known.size + len(words) > self.most:
            self._reset()
        slot = self.known.find(keys)
        if (new := slot < 0).any():
            self.added = self.known.size
            self._add(words.filter(pa.array(new)))
            self.known.add(keys[new])
            slot[new] = np.arange(self.known.size - int(new.sum()), self.known.size)
        slot = slot[index]
        lens = self.len[slot].astype(np.int64)
        ids = self.flat[ragged(self.begin[slot].astype(np.int64), lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(cuts, offs)]
        return ids, np.diff(ends)


_ENCODERS: dict[str, PieceEncoder] = {}


def _encode(batches, vocabulary: str, end_id: int):
    """(doc_id, ids) batches of (doc_id, text) batches."""
    encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, PieceEncoder(vocabulary))
    for batch in batches:
        for ids, offs, data in text_chunks(batch, limit=ENCODE_BYTES):
            tokens, lens = encoder(offs, data)
            tokens = np.insert(tokens, np.cumsum(lens), end_id).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lens + 1)]) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(tokens)]).cast(pa.binary())], ["doc_id", "ids"])


def _texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's token ids as little-endian unsigned 32-bit integers, the end id last."""
    tune(docs.sparkSession)
    return _texts(docs, id_col, text_col).mapInArrow(lean(lambda batches: _encode(batches, vocabulary, end_id)), "doc_id long, ids binary")


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, chunk_bits: int = 8, image_tokens: int = IMAGE_TOKENS) -> None:
    """Write images of all documents in ascending doc_id order, with their place, as the table at ``path``.

    Texts are encoded where they are read; ids (two bytes each, as 16-bit halves where they fit) move once, to the
    range of doc_id they belong to, a task for each. Range borders come from approximate quantiles of doc_id alone.
    """
    spark = docs.sparkSession
    n = n_buckets(spark)
    borders = sorted({int(x) for x in docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    edges = np.array(borders, np.int64)
    tune(spark)

    def place(batches):  # in the worker that encodes
        for b in _encode(batches, vocabulary, end_id):
            part = np.searchsorted(edges, b.column(0).to_numpy(), side="left").astype(np.int32)
            small = [pa.scalar(np.frombuffer(x, "<u4").astype("<u2").tobytes() + b"\2" if len(x) and np.frombuffer(x, "<u4").max() < 65536 else x + b"\4").as_py() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), pa.array(small, pa.binary())], ["part", "doc_id", "ids"])

    moved = _texts(docs).mapInArrow(lean(place), "part int, doc_id long, ids binary").repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")

    def build(batches):
        part, docs_, lens, held, count, start, seq = None, [], [], [], 0, 0, 0

        def image():
            nonlocal docs_, lens, held, count, start, seq
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start_in_part": [start], "n_tokens": [count], "image": pa.array([DacImage.build(np.array(docs_, np.int64), np.array(lens, np.int64), np.concatenate(held), chunk_bits)], pa.binary())})
            start, seq, docs_, lens, held, count = start + count, seq + 1, [], [], [], 0
            return row

        for b in batches:
            for p, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if docs_ and (p != part or count >= image_tokens):
                    yield image()
                if p != part:
                    part, start, seq = p, 0, 0
                raw = x.as_buffer()
                width = raw[len(raw) - 1 :].to_pybytes()[0]
                ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4", (len(raw) - 1) // width)
                docs_.append(d)
                lens.append(len(ids))
                held.append(ids.astype(np.uint16) if width == 2 else ids)
                count += len(ids)
        if docs_:
            yield image()

    moved.mapInArrow(lean(build), "part int, seq int, start_in_part long, n_tokens long, image binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the images.

    One number for each range (as many as there were shuffle partitions) is summed up to place the ranges.
    """
    images = spark.read.parquet(path)
    totals = images.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def read(batches):
        for b in batches:
            for start, base, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                image = DacImage(raw)
                ids = image.decode().astype("<u4")
                at = image.starts
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(image.doc_ids), pa.array(at[:-1] + start + base), pa.array(np.diff(at)), pa.array(np.array(crc, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return images.join(F.broadcast(bases), "part").select("start_in_part", "base", "image").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_token_files(spark, path)
