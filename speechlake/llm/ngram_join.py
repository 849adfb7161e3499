"""Similarity join of documents on word shingles, by parity sketches.

A document's set of distinct shingles is cut into the chunks of a sketch (the number follows its size band); a
chunk's value is the XOR of the hashes of its shingles, so two sketches differ in at most as many chunks as the
sets differ in shingles. At the wanted similarity that is at most D(size), so of any D + 1 chunks that a
document fills one agrees (pigeonhole). Which chunks those are is ruled by one order of chunk values, the same
for all documents: rarest first by a count sketch of fixed size, so that frequent passages, which would bring
together whole crowds, are used last. Agreeing chunks bring candidates together; every link is verified on whole
shingle sets.

Copies (equal sets) are represented by the smallest doc_id. Within a group that shares a chunk value, first only
pairs with its likely origin are verified; of what that leaves in different components every pair is held against the bound that
sketches give, and verified if it passes, so no link between components is lost.

Defined results: null texts and texts without words have no shingles, size 0 and themselves as component; a text
with fewer words than a shingle is one shingle; copies share a component; rows that repeat a doc_id are one document,
of the text that sorts first, and get its result each; rows without a doc_id give none; an empty table gives no
rows; extra columns are ignored (kept where documents are filtered).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import BROADCAST_IDS, LOWER, bucket_of, checkpointed, groups_of, ids_if_small, join_classes, lean, mix64, pack, release, runs, unpack, word_hashes
from speechlake.llm.components import COMPONENTS_SQL, connected_components
from speechlake.llm.text_store import build_store, distinct_documents, for_each_row, read_blob, take, with_keys, with_messages

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Counters of each of two rows of the count sketch that rules the order of chunks.
COUNTERS = 1 << 18
#: Most pairs that a task holds before it lets them go; documents of a group that are compared in one place.
HELD_PAIRS, GROUP_BLOCK = 1_000_000, 2048
#: Copies of a group's entry where groups of several blocks are too many to be broadcast.
SALTS = 32
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULT = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x2545F4914F6CDD1D)]


def shingle_sets(offs: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each document, ascending; borders)."""
    data = LOWER[data]
    starts, ends, words = runs(~_SPACE[data], offs)
    h = word_hashes(data, starts, ends)
    edge = np.concatenate([[0], np.cumsum(words)])
    full = np.zeros(max(0, len(h) - size + 1), _U)
    for k in range(size):
        full += h[k : k + len(full)] * _MULT[k % len(_MULT)] if len(full) else full
    full = mix64(full)
    sets, lens = [], np.zeros(len(words), np.int64)
    for d, n in enumerate(words):
        a = edge[d]
        if n >= size:
            s = np.sort(full[a : a + n - size + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            s = mix64(np.array([sum(int(x) * int(_MULT[k % len(_MULT)]) for k, x in enumerate(h[a : a + n])) + int(n) & (1 << 64) - 1], _U))
        else:
            continue
        sets.append(s)
        lens[d] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(lens)])


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> _U(20)) % _U(COUNTERS), (h >> _U(41)) % _U(COUNTERS)


def band_of(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)


def chunks_of(band: np.ndarray) -> np.ndarray:
    """Chunks of the sketches of a band (sizes 2^band and up to twice that); small sets get so many that shingles hardly share one."""
    return np.where(band < 6, 1 << 16, 3 * 2 ** np.maximum(band - 2, 0)).astype(np.int64)


def most_apart(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Most shingles in which a set may differ from any one similar to it: (100 - p)(size + 100 size / p) / (100 + p)."""
    return (100 - percent) * size // percent


def chunk_keys(sets: np.ndarray, edge: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of the chunks that each document posts, in its own band and, if it may have partners there, the next."""
    size = np.diff(edge)
    a, b = _slots(sets)
    rarity = np.minimum(counts[0][a], counts[1][b]).astype(np.int64)
    out_keys, out_docs = [], []
    for next_band in (0, 1):
        band = band_of(size) + next_band
        who = np.flatnonzero((size > 0) & ((next_band == 0) | (100 * size // percent >= 2.0**band)))
        if not len(who):
            continue
        lens = size[who]
        at = np.repeat(edge[:-1][who] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        doc, n = np.repeat(np.arange(len(who)), lens), np.repeat(chunks_of(band[who]), lens).astype(_U)
        h = sets[at]
        chunk = (((h & _U(0xFFFFFFFF)) * n) >> _U(32)).astype(np.int64)
        order = np.argsort(doc * (1 << 24) + chunk, kind="stable") if n.max(initial=0) < 1 << 24 else np.lexsort((chunk, doc))
        doc, chunk, h, rare = doc[order], chunk[order], h[order], rarity[at][order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1])]))
        value = mix64(np.bitwise_xor.reduceat(mix64(h), first) + chunk[first].astype(_U) * _MULT[5] + band[who][doc[first]].astype(_U) * _MULT[6])
        rare, doc = np.minimum.reduceat(rare, first), doc[first]
        order = np.lexsort((value, rare, doc))
        value, doc = value[order], doc[order]
        filled = np.bincount(doc, minlength=len(who))
        need = most_apart(lens, percent) + 1
        if (filled < np.minimum(need, lens)).any():
            raise ValueError("shingle hashes fill too few chunks for the pigeonhole; give another hash")
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(filled) - filled, filled)
        post = rank < need[doc]
        out_keys.append(value[post])
        out_docs.append(who[doc[post]])
    if not out_keys:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_docs)


def sketch_bits(size: np.ndarray) -> np.ndarray:
    return np.clip(2 ** (band_of(size) + 1), 64, 4096)


def sketches(sets: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """A parity sketch of each set: bit i tells whether an odd number of its shingles hash to i."""
    size = np.diff(edge)
    bits = sketch_bits(size)
    base = np.cumsum(bits) - bits
    doc = np.repeat(np.arange(len(size)), size)
    odd = np.bincount(base[doc] + ((sets >> _U(9)) & (bits[doc] - 1).astype(_U)).astype(np.int64), minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : (a + b) // 8] for a, b in zip(base.tolist(), bits.tolist(), strict=True)]


def fold_sketch(sketch: bytes, size: int) -> np.ndarray:
    """The sketch with ``size`` bytes: its parts XORed."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending sets have 100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _pieces(blobs):
    """The store's parts in chunks of about a megabyte."""
    for blob in blobs:
        ids, offs, data = read_blob(blob)
        at = 0
        while at < len(ids):
            to = min(len(ids), max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), side="right")) - 1))
            yield ids[at:to], offs[at : to + 1] - offs[at], data[offs[at] : offs[to]]
            at = to


def _documents(store: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, n, d1, d2, sketch) with a digest and the parity sketch of each set; the count sketch, 2 x COUNTERS)."""
    names = ["doc_id", "n", "d1", "d2", "sketch", "counts"]

    def run(batches):
        counts = np.zeros((2, COUNTERS), np.uint32)
        for batch in batches:
            for ids, offs, data in _pieces(batch.column("blob").to_pylist()):
                sets, edge = shingle_sets(offs, data, size)
                for row, slot in zip(counts, _slots(sets), strict=True):
                    row += np.bincount(slot.astype(np.int64), minlength=COUNTERS).astype(np.uint32)
                n = np.diff(edge)
                sums = [np.concatenate([np.zeros(1, _U), np.cumsum(mix64(sets ^ m))]) for m in _MULT[:2]]
                d = [(s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(d[0]), pa.array(d[1]), pa.array(sketches(sets, edge), pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), pa.array([pack(counts, level=1)], pa.binary())], names)

    found = checkpointed(store.mapInArrow(lean(run), "doc_id long, n long, d1 long, d2 long, sketch binary, counts binary"))

    def add(batches):
        total = np.zeros((2, COUNTERS), np.uint64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += unpack(blob, np.uint32)[0].reshape(2, COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array([pack(total, level=1)], pa.binary())], ["counts"])

    parts = found.where(F.col("counts").isNotNull()).select("counts").coalesce(8).mapInArrow(lean(add), "counts binary").collect()  # eight sketches
    total = np.zeros((2, COUNTERS), np.uint64)
    for r in parts:
        total += unpack(bytes(r.counts), np.uint64)[0].reshape(2, COUNTERS)
    return found.where(F.col("doc_id").isNotNull()).drop("counts"), np.minimum(total, 0xFFFFFFFF).astype(np.uint32)


def _as_blobs(pairs: DataFrame, n: int, key: str, value: str) -> DataFrame:
    """(b, blob) messages for the bucket of ``key``: its and ``value``'s longs, packed by each task."""

    def run(batches):
        k, v = [], []
        for batch in batches:
            k.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            v.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, k)) > 1_000_000:
                yield _blobs(np.concatenate(k), np.concatenate(v), n)
                k, v = [], []
        if k:
            yield _blobs(np.concatenate(k), np.concatenate(v), n)

    return pairs.select(key, value).mapInArrow(lean(run), "b int, blob binary")


def _blobs(k: np.ndarray, v: np.ndarray, n: int) -> pa.RecordBatch:
    rows = [(b, pack(k[at], v[at])) for b, at in groups_of(bucket_of(k, n))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["b", "blob"])


def _pair_rows(a: np.ndarray, b: np.ndarray, n: int) -> pa.RecordBatch:
    """What the check of pairs needs: kind 0, for a's bucket, the buckets that its text goes to (each once); kind 1, for b's bucket, the pairs."""
    to = bucket_of(b, n).astype(np.int64)
    order = np.lexsort((to, a))
    x, y = a[order], to[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
    x, y = x[new], y[new]
    rows = [(0, k, pack(x[at], y[at])) for k, at in groups_of(bucket_of(x, n))] + [(1, k, pack(a[at], b[at])) for k, at in groups_of(to)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "b", "blob"])


def _unique_pairs(parts) -> tuple[np.ndarray, np.ndarray]:
    x, y = (np.concatenate(z) for z in zip(*parts, strict=True))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
    return x[new], y[new]


def _postings(store: DataFrame, n: int, representatives: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(b, blob): chunk keys of a key bucket with the documents that post them."""
    shared = store.sparkSession.sparkContext.broadcast(counts)  # 2 x COUNTERS

    def post(parts, messages):
        wanted = np.sort(np.concatenate([unpack(m, np.int64, np.int64)[0] for m in messages])) if messages else np.zeros(0, np.int64)
        held: list[tuple] = []
        room = 0
        for ids, offs, data in _pieces(parts):
            rows = np.flatnonzero(np.isin(ids, wanted))
            if not len(rows):
                continue
            o, d = take(offs, data, rows)
            sets, edge = shingle_sets(o, d, size)
            keys, docs = chunk_keys(sets, edge, shared.value, percent)
            held.append((keys, docs, ids[rows], np.diff(edge)))
            room += len(keys)
            if room > 1_500_000:
                yield from flush(held)
                held, room = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        base = np.cumsum([0] + [len(h[2]) for h in held])
        keys = np.concatenate([h[0] for h in held])
        docs = np.concatenate([h[1] + b for h, b in zip(held, base[:-1], strict=True)])
        ids, sizes = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        order = np.argsort(ids, kind="stable")  # ascending ids are small steps, which compress
        ids, sizes, docs = ids[order], sizes[order], np.argsort(order, kind="stable")[docs]
        for b, at in groups_of((keys % _U(n)).astype(np.int64)):
            used, slot = np.unique(docs[at], return_inverse=True)
            yield b, pack(pack((keys[at] >> _U(32)).astype("<u4"), slot.astype("<u2" if len(used) < 1 << 16 else "<u4"), level=None), pack(np.diff(ids[used], prepend=0), sizes[used].astype("<u4"), level=3), bytes([2 if len(used) < 1 << 16 else 4]), level=None)

    return with_messages(store, _as_blobs(representatives, n, "doc_id", "doc_id"), post, "b int, blob binary").repartition(n, "b")


def _candidates(postings: DataFrame, n: int, percent: int) -> DataFrame:
    """kinds 0 and 1: pairs to verify (see _pair_rows); kind 2: groups of more than two documents (group, document, size)."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(b, []).append(blob)
                # parts of a bucket lie together: they were sorted by it
                for done in [k for k in held if k != b]:
                    yield from join(done, held.pop(done))
        for b in list(held):
            yield from join(b, held.pop(b))

    def join(bucket, blobs):
        keys, slots, ids, sizes, base = [], [], [], [], 0
        for blob in blobs:
            post, docs, width = unpack(blob, bytes, bytes, bytes)
            k, s = unpack(post, "<u4", f"<u{width[0]}")
            i, z = unpack(docs, np.int64, "<u4")
            i = np.cumsum(i)
            keys.append(k)
            slots.append(s.astype(np.uint32) + np.uint32(base))
            ids.append(i)
            sizes.append(z)
            base += len(i)
        ids, back = np.unique(np.concatenate(ids), return_inverse=True)
        size = np.zeros(len(ids), np.int64)
        size[back] = np.concatenate(sizes)
        key = (np.concatenate(keys).astype(_U) << _U(32)) | back[np.concatenate(slots)].astype(_U)
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        group = key >> _U(32)
        same = group[1:] == group[:-1]
        inside = np.zeros(len(key), bool)
        inside[1:] |= same
        inside[:-1] |= same
        key = key[inside]
        group, doc = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64)
        # The document that shares most with others is the likely origin of their copies: all of a group meet it.
        _, place, count = np.unique(group, return_inverse=True, return_counts=True)
        shares = np.bincount(doc, weights=(count - 1)[place], minlength=len(ids))
        order = np.lexsort((doc, -shares[doc], group))
        g, d = group[order], doc[order]
        hub = np.repeat(d[np.concatenate([[True], g[1:] != g[:-1]])], count) if len(g) else d
        a, b = _unique_pairs([(hub, d)])
        fit = (a != b) & (np.minimum(size[a], size[b]) * 100 >= percent * np.maximum(size[a], size[b]))
        if fit.any():
            yield _pair_rows(ids[a[fit]], ids[b[fit]], n)
        # Larger groups, each distinct one once, may hold links that their origin does not show.
        _, first, count = np.unique(group, return_index=True, return_counts=True)
        large = count > 2
        first, count = first[large], count[large]
        if len(first):
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            starts = np.cumsum(count) - count
            sums = np.add.reduceat(mix64(ids[doc[at]].view(_U)), starts)
            _, keep = np.unique(sums, return_index=True)
            rows = np.concatenate([np.arange(starts[k], starts[k] + count[k]) for k in keep])
            label = np.repeat(sums.view(np.int64), count)  # the same group, from whatever bucket, has the same label
            d = doc[at]
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([bucket], pa.int32()), pa.array([pack(label[rows], ids[d[rows]], size[d[rows]])], pa.binary())], ["kind", "b", "blob"])

    return postings.sortWithinPartitions("b").mapInArrow(lean(run), "kind int, b int, blob binary")


def _verify(store: DataFrame, n: int, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of the pairs that are similar, on whole shingle sets; pairs: rows of _pair_rows.

    A text travels once to each bucket where it has partners; pairs go to the bucket of b, so that a document with
    very many partners gathers nothing but a list of buckets.
    """

    def send(parts, messages):
        if not messages:
            return
        a, to = _unique_pairs([unpack(m, np.int64, np.int64) for m in messages])
        for part in parts:
            ids, offs, data = read_blob(part)
            place = {x: k for k, x in enumerate(ids.tolist())}
            mine = np.flatnonzero(np.isin(a, ids))
            for bucket, at in groups_of(to[mine]):
                need = a[mine[at]]
                o, d = take(offs, data, np.array([place[x] for x in need.tolist()]))
                yield bucket, b"T" + pack(need, o, d)

    def check(parts, messages):
        asked = [unpack(m[1:], np.int64, np.int64) for m in messages if m[:1] == b"P"]
        u, v = [], []
        if not asked:
            return u, v
        a, b = _unique_pairs(asked)
        wanted, mine = np.unique(b), {}
        for part in parts:
            ids, offs, data = read_blob(part)
            rows = np.flatnonzero(np.isin(ids, wanted))
            for at in range(0, len(rows), 256):
                k = rows[at : at + 256]
                s, e = shingle_sets(*take(offs, data, k), size)
                mine.update((x, s[e[j] : e[j + 1]]) for j, x in enumerate(ids[k].tolist()))
        for m in messages:
            if m[:1] != b"T":
                continue
            ids, offs, data = unpack(m[1:], np.int64, np.int64, np.uint8)
            for at in range(0, len(ids), 256):
                k = np.arange(at, min(len(ids), at + 256))
                sets, edge = shingle_sets(*take(offs, data, k), size)
                for j, x in enumerate(ids[k].tolist()):
                    s = sets[edge[j] : edge[j + 1]]
                    for y in b[np.searchsorted(a, x, side="left") : np.searchsorted(a, x, side="right")].tolist():
                        if similar(s, mine[y], percent):
                            u.append(x)
                            v.append(y)
        return u, v

    sent = with_messages(store, pairs.where("kind = 0").select("b", "blob"), send)
    asked = pairs.where("kind = 1").select("b", F.concat(F.lit(b"P"), "blob").alias("blob"))
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return with_messages(store, sent.unionByName(asked), check, "a long, b long", fields, columns=True)


def _across(groups: DataFrame, components: DataFrame, drawn: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of _pair_rows for documents of a group that lie in different components, unless their sketches are too far apart for them to be similar.

    Larger groups are cut into blocks of about GROUP_BLOCK, and every two blocks meet apart. drawn: (doc_id, sketch).
    """

    def spread(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                label, doc, size = unpack(blob, np.int64, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(doc), pa.array(size)], ["label", "doc", "size"])

    rows = groups.select("blob").mapInArrow(lean(spread), "label long, doc long, size long").distinct()
    named = checkpointed(rows.join(components, F.col("doc") == F.col("node"), "left").select("label", "doc", "size", F.coalesce("component", "doc").alias("c")))
    spans = named.groupBy("label").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("g")).where("low <> high")
    spans = checkpointed(spans.select(F.col("label").alias("open"), F.ceil(F.col("g") / GROUP_BLOCK).cast("int").alias("blocks")))
    # Groups of several blocks are few and meet their rows by broadcast, or in salted copies; no other label has over a block of rows.
    wide, narrow = spans.where("blocks > 1"), spans.where("blocks = 1")
    if wide.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        marked = named.join(F.broadcast(wide.select(F.col("open").alias("wide"), F.col("blocks").alias("n_blocks"))), F.col("label") == F.col("wide"), "left")
        key = F.when(F.col("wide").isNull(), F.col("label")).otherwise(F.xxhash64("doc", "label"))
        held = marked.withColumn("_ask", key).join(narrow, F.col("_ask") == F.col("open"), "left")
        held = held.select("label", "doc", "size", "c", F.coalesce("n_blocks", F.when(F.col("_ask") == F.col("label"), F.col("blocks"))).alias("blocks")).where("blocks is not null")
    else:
        copies = spans.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = named.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(copies, (F.col("label") == F.col("open")) & (F.col("_salt") == F.col("_copy"))).select("label", "doc", "size", "c", "blocks")
    held = held.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))))
    dealt = held.join(drawn, F.col("doc") == F.col("doc_id")).select("label", "c", "doc", "size", "sketch", "block", meets.alias("meet"))
    open_groups = dealt.groupBy("label", "meet").agg(F.collect_list(F.struct("c", "doc", "size", "block", "sketch")).alias("m"))

    def pair(batches):
        held, room = [], 0
        for batch in batches:
            for m in batch.column(0):
                rows = pa.RecordBatch.from_struct_array(m.values)
                c, doc, size, block = (x.to_numpy(zero_copy_only=False) for x in rows.columns[:4])
                raw = rows.column(4).to_pylist()
                width = min(map(len, raw))
                bits = np.stack([fold_sketch(x, width) for x in raw])
                order = np.argsort(size, kind="stable")
                c, doc, size, block, bits = (x[order] for x in (c, doc, size, block, bits))
                reach = np.searchsorted(size, 100 * size // percent, side="right")
                two = block.min() != block.max()
                for k in range(len(doc)):
                    near = np.arange(k + 1, reach[k])
                    near = near[(c[near] != c[k]) & ((block[near] != block[k]) | (not two))]
                    apart = np.bitwise_count(bits[near] ^ bits[k]).sum(1, dtype=np.int64)
                    near = near[apart * (100 + percent) <= (100 - percent) * (size[near] + size[k])]
                    if len(near):
                        held.append((np.minimum(doc[k], doc[near]), np.maximum(doc[k], doc[near])))
                        room += len(near)
                    if room > HELD_PAIRS:
                        held = [_unique_pairs(held)]
                        room = len(held[0][0])
                        if room > HELD_PAIRS // 2:
                            yield _pair_rows(*held[0], n)
                            held, room = [], 0
        if held:
            yield _pair_rows(*_unique_pairs(held), n)

    return open_groups.select("m").mapInArrow(lean(pair), "kind int, b int, blob binary")


def shingle_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: components of the graph of similar documents."""
    spark = docs.sparkSession
    unique, repeated = distinct_documents(docs)
    store, n = build_store(unique)
    release(spark)
    found, counts = _documents(store, size)
    classes = checkpointed(found.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    postings = _postings(store, n, classes.select(F.col("first").alias("doc_id")), counts, size, percent)
    candidates = checkpointed(_candidates(postings, n, percent))
    del postings
    release(spark)
    links = checkpointed(_verify(store, n, candidates.where("kind < 2"), size, percent))
    release(spark)
    groups = candidates.where("kind = 2").select("blob")
    components = connected_components(links)
    if not groups.isEmpty():
        more = checkpointed(_verify(store, n, checkpointed(_across(groups, components, found.select("doc_id", "sketch"), n, percent)), size, percent))
        if not more.isEmpty():
            components = connected_components(links.unionByName(more))
    known = classes.join(components, F.col("first") == F.col("node"), "left").select("d1", "d2", "n", "copies", F.coalesce("component", "first").alias("component_id"))
    filled = lambda c: F.when(F.col("n") > 0, F.col(c)).alias(c)  # noqa: E731  empty sets are no class
    rows = join_classes(found.select("doc_id", filled("d1"), filled("d2"), "n"), checkpointed(known), ["d1", "d2", "n"], ["component_id"], F.xxhash64("doc_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return for_each_row(out, docs, repeated)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that are similar, by links, to an earlier one: of a smaller doc_id, and of rows that share one, of the text that sorts first. Rows without a doc_id come last and are judged too; repeated rows leave one."""
    rows, key = with_keys(docs)
    found = shingle_components(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = checkpointed(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")))
    return rows.join(ids_if_small(gone), rows[key] == gone["_gone"], "left_anti").select(*[rows[c] for c in docs.columns])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = (
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
both_ways AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_have >= 80 * (a.n + b.n - both_have)),
nodes AS (SELECT doc_id AS id FROM documents),
"""
    + COMPONENTS_SQL
    + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id FROM documents d JOIN component c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
)
