"""Exact repeats of long byte strings across a corpus, by sorted suffixes.

Every window of WIDTH bytes has an anchor: the leftmost smallest hash among its GRAM-byte strings, so equal
windows have equal anchors at equal places. A block is a run of windows with one anchor. Blocks of equal
content are folded to their earliest; only anchors under which different blocks remain (the edges of repeats)
send their few bytes, whose suffixes to the right and, mirrored, to the left of the anchor are put in order by
deep-shallow sorting. A window has been seen before if an earlier block agrees with it on both sides, which the
common prefixes of neighbours in both orders tell for all windows at once. So work grows with the text and not
with the square of a group of repeats.

Defined results: null and empty texts have no bytes; texts shorter than a window keep all; ties cannot
occur (a start is a doc_id and a place); rows that repeat a doc_id are one document, of the text that sorts first, and
get its result each; rows without a doc_id give none; an empty table gives no rows; extra columns are ignored (kept
where documents are cleaned).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import RangeHash, bucket_of, checkpointed, groups_of, ids_if_small, lean, mix64, pack, ragged, release, unpack
from speechlake.llm.suffix_sort import deep_shallow_sort
from speechlake.llm.text_store import build_store, distinct_documents, for_each_row, read_blob, with_keys, with_messages

#: Bytes of a window and of the strings that anchors are chosen from (a power of two).
WIDTH, GRAM = 100, 32
#: Bytes of two strings that cover a window together (a power of two).
HALF = 64
#: Different blocks under one anchor from which they are dealt by window instead of meeting in one task.
CROWD = 2048
#: Bytes of text handled at once; a longer text is handled in parts that overlap.
SEGMENT = 1 << 20
#: Anchors that a task folds before it sends them, blocks whose suffixes are sorted at once.
FOLD, SORT_AT_ONCE = 400_000, 60_000
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_SEED = mix64(np.arange(1, 257, dtype=_U) * _U(0x9FB21C651E98DF25))
_STEP = [_U(0xD1B54A32D192ED03), _U(0xAEF17502108EF2D9), _U(0x8CB92BA72F3D8DD7), _U(0xDB4F0B9175AE2165), _U(0xBBE0563303A4615F), _U(0xA0F2EC75A1FE1575)]


def segments(blobs):
    """(ids, offsets, bytes, place of the first byte in its document) of about SEGMENT bytes; a longer text gives parts that share WIDTH - 1 bytes."""
    for blob in blobs:
        ids, offs, data = read_blob(blob)
        at = 0
        while at < len(ids):
            to = min(len(ids), max(at + 1, int(np.searchsorted(offs, offs[at] + SEGMENT, side="right")) - 1))
            a, z = int(offs[at]), int(offs[to])
            if to == at + 1 and z - a > 2 * SEGMENT:
                for s in range(a, z, SEGMENT):
                    e = min(z, s + SEGMENT + WIDTH - 1)
                    yield ids[at:to], np.array([0, e - s]), data[s:e], np.array([s - a])
            else:
                yield ids[at:to], offs[at : to + 1] - a, data[a:z], np.zeros(to - at, np.int64)
            at = to


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes (a power of two), of another family than RangeHash."""
    h, size, k = _SEED[data], 1, 0
    while size < width:
        h = h[:-size] * _STEP[k] + h[size:]
        size, k = 2 * size, k + 1
    return mix64(h)


def window_hashes(data: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at p: 128 bits, so that no two of a whole corpus are mistaken for each other."""
    half = string_hashes(data, HALF) if len(p) else np.zeros(0, _U)
    return RangeHash(data)(p, p + WIDTH), half[p] * _STEP[0] + half[p + WIDTH - HALF]


def blocks_of(offs: np.ndarray, data: np.ndarray):
    """(document row, first window, windows, anchor, hash of the anchor's string, hash of the block) of every block."""
    n = len(data)
    counts = np.maximum(0, np.diff(offs) - WIDTH + 1)
    if n < WIDTH or not counts.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(_U), z.view(_U)
    h = string_hashes(data, GRAM)
    m = (h & ~_LOW) | np.arange(len(h), dtype=_U)
    span, size = WIDTH - GRAM + 1, 1
    while 2 * size <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: n - WIDTH + 1], m[span - size : span - size + n - WIDTH + 1])
    doc = np.repeat(np.arange(len(counts)), counts)
    window = ragged(offs[:-1], counts)
    anchor = (m[window] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    size = np.diff(np.append(first, len(window)))
    start, a = window[first], anchor[first]
    block = RangeHash(data)(start, start + size - 1 + WIDTH) ^ mix64((a - start).astype(_U) * _STEP[5])
    return doc[first], start, size, a, h[a], block


def _pack_spans(doc: np.ndarray, at: np.ndarray, windows: np.ndarray, n: int, kind: int):
    order = np.lexsort((at, doc))
    doc, at, windows = doc[order], at[order], windows[order]
    for b, rows in groups_of(bucket_of(doc, n)):
        yield kind, b, pack(doc[rows], at[rows].astype("<i8"), windows[rows].astype("<i8"))


def _rows(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "b", "blob"])


def _fold(gram, block, doc, at):
    """Positions in order of (gram, block, doc, place), and which of them is the first of its gram and block."""
    order = np.lexsort((at, doc, block, gram))
    g, b = gram[order], block[order]
    return order, np.concatenate([[True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])]) if len(g) else np.zeros(0, bool)


_KINDS = "kind int, b int, blob binary"


def _anchors(store: DataFrame, n: int) -> DataFrame:
    """kind 0: blocks for the bucket of their anchor; kind 1: windows that an earlier block of the same task repeats, for their document."""

    def run(batches):
        held, room = [], 0

        def out():
            gram, block, doc, at, windows, lead = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = _fold(gram, block, doc, at)
            again, once = order[~first], order[first]
            rows = list(_pack_spans(doc[again], at[again], windows[again], n, 1))
            for b, k in groups_of((gram[once] % _U(n)).astype(np.int64)):
                k = once[k]
                k = k[np.lexsort((at[k], doc[k]))]
                own, slot = np.unique(doc[k], return_inverse=True)
                rows.append((0, b, pack(pack(gram[k], block[k], level=None), pack(own, slot.astype("<u4"), at[k].astype("<i8"), windows[k].astype("u1"), lead[k].astype("u1")), level=None)))
            return _rows(rows)

        for batch in batches:
            for ids, offs, data, base in segments(batch.column("blob").to_pylist()):
                doc, start, size, a, gram, block = blocks_of(offs, data)
                if len(doc):
                    held.append((gram, block, ids[doc], start - offs[doc] + base[doc], size, a - start))
                    room += len(doc)
                if room >= FOLD:
                    yield out()
                    held, room = [], 0
        if held:
            yield out()

    return store.mapInArrow(lean(run), _KINDS).repartition(n, "b")


def _by_bucket(batches, meet):
    """meet(bucket, {kind: blobs}) for each bucket of rows that lie together."""
    now, held = None, {}
    for batch in batches:
        for kind, b, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != now and held:
                yield from meet(now, held)
                held = {}
            now = b
            held.setdefault(kind, []).append(blob)
    if held:
        yield from meet(now, held)


def _fold_all(anchors: DataFrame, n: int) -> DataFrame:
    """kind 1: windows of blocks that an earlier block equals; kinds 2 and 3: the earliest of each of several blocks under one anchor, few or a crowd, for their document."""

    def meet(b, held):
        if 1 in held:
            yield _rows((1, b, x) for x in held[1])
        if 0 not in held:
            return
        parts = []
        for blob in held[0]:
            hashes, rest = unpack(blob, bytes, bytes)
            gram, block = unpack(hashes, _U, _U)
            own, slot, at, windows, lead = unpack(rest, np.int64, "<u4", "<i8", "u1", "u1")
            parts.append((gram, block, own[slot], at, windows, lead))
        gram, block, doc, at, windows, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order, first = _fold(gram, block, doc, at)
        again, once = order[~first], order[first]
        g = gram[once]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        several = np.repeat(np.diff(np.append(starts, len(g))), np.diff(np.append(starts, len(g))))
        rows = list(_pack_spans(doc[again], at[again], windows[again].astype(np.int64), n, 1))
        for kind, want in ((2, (several > 1) & (several <= CROWD)), (3, several > CROWD)):
            k = once[want]
            k = k[np.lexsort((at[k], doc[k]))]
            for to, r in groups_of(bucket_of(doc[k], n)):
                r = k[r]
                rows.append((kind, to, pack(np.array([kind], np.int64), gram[r], doc[r], at[r], windows[r], lead[r])))
        if rows:
            yield _rows(rows)

    return anchors.sortWithinPartitions("b").mapInArrow(lean(lambda batches: _by_bucket(batches, meet)), _KINDS)


def _fetch(store: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """kind 2: bytes of blocks for the bucket of their anchor; kind 3: hashes of a crowd's windows, for theirs; kind 1 as before."""

    def look(parts, messages):
        asked = [unpack(m, np.int64, _U, np.int64, np.int64, "u1", "u1") for m in messages]
        texts = [read_blob(p) for p in parts] if asked else []
        index = {x: (k, j) for k, (ids, _, _) in enumerate(texts) for j, x in enumerate(ids.tolist())}
        seen: list[tuple] = []
        few: list[tuple] = []
        for kind, gram, doc, at, windows, lead in asked:
            own, slot = np.unique(doc, return_inverse=True)
            place = np.array([index[x] for x in own.tolist()], np.int64).reshape(-1, 2)[slot]
            for k, rows in groups_of(place[:, 0]):
                _, offs, data = texts[k]
                start = offs[place[rows, 1]] + at[rows]
                if kind[0] == 2:
                    lens = windows[rows].astype(np.int64) + WIDTH - 1
                    few.append((gram[rows], doc[rows], at[rows], windows[rows], lead[rows], start, lens, k))
                else:
                    count = windows[rows].astype(np.int64)
                    p = ragged(start, count)
                    seen.append((*window_hashes(data, p), np.repeat(doc[rows], count), p - np.repeat(start - at[rows], count)))
        for gram, doc, at, windows, lead, start, lens, k in few:
            for b, r in groups_of((gram % _U(n)).astype(np.int64)):
                yield 2, b, pack(gram[r], doc[r], at[r], windows[r], lead[r], texts[k][2][ragged(start[r], lens[r])])
        if seen:
            h, other, doc, at = (np.concatenate(x) for x in zip(*seen, strict=True))
            order, first = _fold(h, other, doc, at)
            yield from _pack_spans(doc[order[~first]], at[order[~first]], np.ones(int((~first).sum()), np.int64), n, 1)
            once = order[first]
            for b, r in groups_of((h[once] % _U(n)).astype(np.int64)):
                yield 3, b, pack(h[once[r]], other[once[r]], doc[once[r]], at[once[r]])

    fields = pa.schema([("kind", pa.int32()), ("b", pa.int32()), ("blob", pa.binary())])
    return with_messages(store, wanted.select("b", "blob"), look, _KINDS, fields)


def repeated_windows(gram, doc, at, windows, lead, data):
    """(doc, place) of every window of these blocks that one with a smaller (doc, place) equals; blocks differ from each other."""
    order = np.lexsort((at + lead, doc))
    lens = windows.astype(np.int64) + WIDTH - 1
    start = (np.cumsum(lens) - lens)[order]
    gram, doc, at, windows, lead, lens = (x[order] for x in (gram, doc, at, windows.astype(np.int64), lead.astype(np.int64), lens))
    _, group = np.unique(gram, return_inverse=True)
    n = len(gram)
    right = lens - lead
    m = np.zeros((n, int(right.max())), np.uint8)
    rows = np.repeat(np.arange(n), right)
    m[rows, ragged(np.zeros(n, np.int64), right)] = data[ragged(start + lead, right)]
    sides = [deep_shallow_sort(m, right, group)]
    m = np.zeros((n, max(1, int(lead.max()))), np.uint8)
    rows, place = np.repeat(np.arange(n), lead), ragged(np.zeros(n, np.int64), lead)
    m[rows, place] = data[np.repeat(start + lead - 1, lead) - place]
    sides.append(deep_shallow_sort(m, lead, group))
    docs, places = [], []
    for before in range(int(lead.max()) + 1):
        row = np.flatnonzero((before <= lead) & (before > lead - windows))
        if len(row) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (turn, lcp), need in zip(sides, (WIDTH - before, before), strict=True):
            label = np.empty(n, np.int64)
            label[turn] = np.cumsum(lcp < need)
            key = key * (n + 1) + label
        _, first = np.unique(key[row], return_index=True)  # rows go by (doc, place)
        later = np.ones(len(row), bool)
        later[first] = False
        later = row[later]
        docs.append(doc[later])
        places.append((at + lead)[later] - before)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(places)


def _sort_edges(fetched: DataFrame, n: int) -> DataFrame:
    """(b, blob): windows that an earlier one repeats, for their document."""

    def meet(b, held):
        docs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if 2 in held:
            parts = [unpack(x, _U, np.int64, np.int64, "u1", "u1", np.uint8) for x in held[2]]
            gram, doc, at, windows, lead, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            lens = windows.astype(np.int64) + WIDTH - 1
            begin = np.cumsum(lens) - lens
            order = np.argsort(gram, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
            take, edges = 0, [0]
            for c in [*cut[1:].tolist(), len(order)]:
                if c - edges[-1] >= SORT_AT_ONCE or c == len(order):
                    edges.append(c)
            for take, to in zip(edges[:-1], edges[1:], strict=True):
                r = order[take:to]
                d, p = repeated_windows(gram[r], doc[r], at[r], windows[r], lead[r], data[ragged(begin[r], lens[r])])
                docs.append(d)
                places.append(p)
        if 3 in held:
            h, other, doc, at = (np.concatenate(x) for x in zip(*[unpack(x, _U, _U, np.int64, np.int64) for x in held[3]], strict=True))
            order, first = _fold(h, other, doc, at)
            docs.append(doc[order[~first]])
            places.append(at[order[~first]])
        doc, place = np.concatenate(docs), np.concatenate(places)
        rows = [(1, b, x) for x in held.get(1, [])]
        if len(doc):
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)]))
            last = np.append(first[1:], len(doc)) - 1
            rows += _pack_spans(doc[first], place[first], place[last] - place[first] + 1, n, 1)
        if rows:
            yield _rows(rows)

    return fetched.repartition(n, "b").sortWithinPartitions("b").mapInArrow(lean(lambda batches: _by_bucket(batches, meet)), _KINDS)


def _covered(n_bytes: int, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
    delta = np.zeros(n_bytes + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + windows - 1 + WIDTH, -1)
    return np.cumsum(delta[:-1]) > 0


def _without_repeats(docs: DataFrame, each, schema: str, fields: pa.Schema) -> DataFrame:
    """each(doc_id, bytes, mask of bytes that are removed) -> row, for every document; docs: (doc_id, text)."""
    spark = docs.sparkSession
    unique, repeated = distinct_documents(docs)
    store, n = build_store(unique)
    release(spark)
    folded = checkpointed(_fold_all(_anchors(store, n), n))
    release(spark)
    edges = _sort_edges(_fetch(store, n, folded.where("kind > 1")), n)
    spans = folded.where("kind = 1").select("b", "blob").unionByName(edges.select("b", "blob"))

    def write(parts, messages):
        found = [unpack(m, np.int64, "<i8", "<i8") for m in messages]
        doc, at, windows = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        order = np.argsort(doc, kind="stable")
        doc, at, windows = doc[order], at[order], windows[order]
        for part in parts:
            ids, offs, data = read_blob(part)
            low, high = np.searchsorted(doc, ids, side="left"), np.searchsorted(doc, ids, side="right")
            for k, x in enumerate(ids.tolist()):
                text = data[offs[k] : offs[k + 1]]
                yield each(x, text, _covered(len(text), at[low[k] : high[k]], windows[low[k] : high[k]]))

    return for_each_row(with_messages(store, spans, write, schema, fields), docs, repeated)


def removed_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def each(doc_id, text, gone):
        starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        return doc_id, len(text), int(gone.sum()), starts, hashlib.sha256(text[~gone].tobytes()).hexdigest()

    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return _without_repeats(docs, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", fields)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeats cut out of their texts and n_chars, where there is one, counted anew; characters that a cut splits go too. A document of which nothing is left goes.

    Earlier means a smaller doc_id, and of rows that share one, the text that sorts first; rows without one come last.
    """

    def each(doc_id, text, gone):
        return doc_id, text[~gone].tobytes().decode("utf-8", errors="ignore") if gone.any() else None

    rows, key = with_keys(docs)
    fields = pa.schema([("doc_id", pa.int64()), ("_text", pa.string())])
    cut = _without_repeats(rows.select(F.col(key).alias("doc_id"), "text"), each, "doc_id long, _text string", fields)
    cut = checkpointed(cut.where("_text is not null").select(F.col("doc_id").alias("_cut"), F.col("_text").alias("_left")))
    whole = rows.join(ids_if_small(cut.select("_cut")), rows[key] == cut["_cut"], "left_anti").select(*[rows[c] for c in docs.columns])  # texts stay where they are
    rest = rows.drop("text").join(cut.where("_left <> ''"), rows[key] == cut["_cut"])
    new = {"text": cut["_left"]}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(cut["_left"]).cast(docs.schema["n_chars"].dataType)
    return whole.unionByName(rest.select(*[(new[c] if c in new else rows[c]).alias(c) for c in docs.columns]))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS content FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
islands AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM islands GROUP BY doc_id, island),
edges AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_here FROM (SELECT * FROM spans UNION ALL SELECT doc_id, n, n FROM t)),
kept AS (SELECT e.doc_id, sha256(unhex(string_agg(substr(t.h, 2 * e.from_here + 1, 2 * (e.a - e.from_here)), '' ORDER BY e.a))) AS sha FROM edges e JOIN t ON t.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.spans, 0) AS BIGINT) AS n_spans, kept.sha AS kept_sha256
FROM t JOIN kept ON kept.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id) s ON s.doc_id = t.doc_id
"""
