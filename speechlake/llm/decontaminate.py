"""Benchmark decontamination with DataFrame expressions only.

Test windows become a bitmap of hashes, BITS_EACH bits for each window up to BITMAP_BITS in all, which goes to every
task, and a table of exact windows. Each document's windows are tested against the bitmap where the document is read;
only windows that pass, a few more than the true hits, are joined with the table on their words, which verifies them.
Texts are read and never shuffled: what is found is written as a small table, and documents or spans are removed by a
second read that is joined with the digests of the texts that are hit. Windows, sets of items and digests are broadcast
while their counted rows and bytes are within bounds; beyond them windows are shuffled, each in SALTS copies, so that a
window that very many documents hold is spread.

Defined results: null texts and texts without words have no words and no hits; repeated rows are judged each;
items with fewer than the window's words, but not none, are one window; an empty benchmark hits nothing; an
empty table gives no rows; rows without a doc_id are judged like others; extra columns are ignored (or kept, where
documents are filtered). Above BITMAP_BITS / 8 windows more than one window in twenty passes the bitmap without a hit,
which costs time but no result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import checkpointed

WINDOW = 10
#: Bits of the bitmap for each test window, and in all; longs of a row in which the bitmap reaches the driver.
BITS_EACH, BITMAP_BITS, PAGE = 32, 1 << 25, 4096
#: Most rows and bytes of a table that is broadcast (windows, sets of items, digests of hit texts); copies of a window that is shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES, SALTS = 200_000, 32 << 20, 8
#: What lies between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAPS), "")


def window_text(array: Column, at: Column, length: int) -> Column:
    """The words from ``at`` on, joined; element access keeps this in constant time however long the document is."""
    return F.concat_ws(" ", *[array[at + k] for k in range(length)])


def _probe(array: Column, at: Column, length: int) -> Column:
    """A hash of up to four words spread over a window."""
    spread = sorted({0, (length - 1) // 3, 2 * (length - 1) // 3, length - 1})
    return F.xxhash64(F.lit(length), *[array[at + k] for k in spread])


def _starts(array: Column, length: int) -> Column:
    n = F.size(array)
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


class Bitmap:
    """Two bits for each probe (a long), in at most BITMAP_BITS bits that go to every task."""

    def __init__(self, probes: DataFrame, n: int):
        self.probes, self.bits = probes, 1 << 12
        while self.bits < min(BITMAP_BITS, BITS_EACH * n):
            self.bits *= 2
        self.longs = F.split(F.lit(",".join(map(str, self._longs()))), ",").cast("array<bigint>")

    def _longs(self) -> list[int]:
        """At most BITMAP_BITS / 64 longs, a PAGE of them in a row."""
        slots = self.probes.select(F.explode(F.array(*self._slots(F.col("probe")))).alias("slot")).select((F.col("slot") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
        words = slots.groupBy("at").agg(F.bit_or("bit").alias("bits"))
        pages = words.groupBy(F.floor(F.col("at") / PAGE).alias("page")).agg(F.array_join(F.collect_list(F.concat_ws(":", "at", "bits")), ",").alias("longs"))
        longs = [0] * (self.bits // 64)
        for r in pages.collect():
            for x in r["longs"].split(","):
                at, bits = x.split(":")
                longs[int(at)] = int(bits)
        return longs

    def _slots(self, probe: Column) -> list[Column]:
        mask = F.lit(self.bits - 1).cast("long")
        return [probe.bitwiseAND(mask), F.shiftrightunsigned(probe, 30).bitwiseAND(mask)]

    def may_hold(self, probe: Column) -> Column:
        tests = []
        for slot in self._slots(probe):
            word = self.longs[F.shiftrightunsigned(slot, 6).cast("int")]
            tests.append(F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return tests[0] & tests[1]


class TestWindows:
    """The distinct windows of a benchmark: exact table, bitmap, and the lengths that occur."""

    __test__ = False

    def __init__(self, benchmark: DataFrame, window: int = WINDOW):
        items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
        own = F.coalesce(*[F.when(F.size("w") == k, _probe(F.col("w"), F.lit(0), k)) for k in range(1, window)], F.lit(0).cast("long"))
        short = items.where(F.size("w") < window).select("item", F.size("w").alias("len"), F.array_join("w", " ").alias("words"), own.alias("probe"))
        each = F.transform(_starts(F.col("w"), window), lambda i: F.struct(window_text(F.col("w"), i, window).alias("words"), _probe(F.col("w"), i, window).alias("probe")))
        full = items.select("item", F.lit(window).alias("len"), F.explode(each).alias("x")).select("item", "len", "x.words", "x.probe")
        every = checkpointed(short.unionByName(full).distinct())
        # Windows that occur in the same items share a set; a document's items are its sets' items.
        sets = every.groupBy("len", "words", "probe").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set_id", F.md5(F.array_join("items", ",")))
        self.table = checkpointed(sets.select("len", "words", "probe", "set_id"))
        self.sets = checkpointed(sets.select("set_id", F.explode("items").alias("item")).distinct())
        known = self.table.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.octet_length("words") + F.octet_length("set_id")).alias("bytes")).collect()  # at most ``window`` rows
        self.lengths = {r["len"]: r["n"] for r in known}
        self.n = sum(self.lengths.values())
        self.small = self.n <= BROADCAST_WINDOWS and sum(r["bytes"] for r in known) <= BROADCAST_BYTES
        self.bitmap = Bitmap(self.table.select("probe"), self.n)
        self.bits = self.bitmap.bits

    def may_hold(self, probe: Column) -> Column:
        return self.bitmap.may_hold(probe)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _is_small(df: DataFrame, size: Column) -> tuple[bool, int]:
    """Whether a written table may be broadcast, by its rows and the sum of ``size``; its rows."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return r["n"] <= BROADCAST_WINDOWS and r["bytes"] <= BROADCAST_BYTES, r["n"]


def _copied(df: DataFrame) -> DataFrame:
    """df once for each salt, so that what one of its keys meets is many keys."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def scan(docs: DataFrame, tests: TestWindows, keep: list[str]) -> DataFrame:
    """(_at, the columns in ``keep``, n_words, _digest, _hits) of every row: windows that pass the bitmap, and a digest of the text where there are some. A written table without texts, the one pass over them."""
    split = docs.select(*keep, F.monotonically_increasing_id().alias("_at"), _digest(F.col("text")).alias("_digest"), words(F.col("text")).alias("_w"))

    def candidates(k: int) -> Column:
        starts = F.filter(_starts(F.col("_w"), k), lambda i: tests.may_hold(_probe(F.col("_w"), i, k)))
        return F.transform(starts, lambda i: F.struct(F.lit(k).alias("len"), i.alias("pos"), window_text(F.col("_w"), i, k).alias("words")))

    found = [candidates(k) for k in sorted(tests.lengths)]
    hits = F.concat(*found) if found else F.array().cast("array<struct<len:int,pos:int,words:string>>")
    rows = split.select("_at", *keep, F.size("_w").cast("long").alias("n_words"), "_digest", hits.alias("_hits"))
    return checkpointed(rows.withColumn("_digest", F.when(F.size("_hits") > 0, F.col("_digest"))))


def find_hits(scanned: DataFrame, tests: TestWindows) -> DataFrame:
    """(_at, digest, spans, set_ids, n_hit) of the rows that hold a test window: sorted word ranges, the items' sets and how many words are hit."""
    each = scanned.where(F.size("_hits") > 0).select("_at", F.col("_digest").alias("digest"), F.explode("_hits").alias("h")).select("_at", "digest", "h.len", "h.pos", "h.words")
    table, on = tests.table.select("len", "words", "set_id"), ["len", "words"]
    if tests.small:
        table = F.broadcast(table)
    else:  # a window of a third of all documents is many keys
        each = each.withColumn("_salt", F.pmod(F.xxhash64("_at", "pos"), F.lit(SALTS)).cast("int"))
        table, on = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"]
    true = each.join(table, on)
    span = F.struct(F.col("pos").alias("begin"), (F.col("pos") + F.col("len")).alias("end"))
    whole = true.groupBy("_at").agg(F.first("digest").alias("digest"), F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("set_id").alias("set_ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")),
        lambda a: a["n"],
    )
    return whole.withColumn("n_hit", covered)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs."""
    tests = TestWindows(benchmark, window)
    scanned = scan(docs, tests, ["doc_id"])
    hits = checkpointed(find_hits(scanned, tests).select("_at", "n_hit", "set_ids"))
    each = hits.select("_at", F.explode("set_ids").alias("set_id"))
    if _is_small(tests.sets, F.octet_length("item") + 32)[0]:
        each = each.join(F.broadcast(tests.sets), "set_id")
    else:  # one passage may be in a third of all documents
        each = each.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int")).join(_copied(tests.sets), ["set_id", "_salt"])
    items = each.groupBy("_at").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("_at").alias("_item_at"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    known = hits.select(F.col("_at").alias("_hit_at"), "n_hit").join(items, F.col("_hit_at") == F.col("_item_at"))
    rows = scanned.select("_at", "doc_id", "n_words").join(known, F.col("_at") == F.col("_hit_at"), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, what: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without what the benchmark hits: whole ``documents``, or ``spans`` (the text is then its other words, joined by spaces; untouched texts stay as they are)."""
    tests = TestWindows(benchmark, window)
    hits = find_hits(scan(docs.select("text"), tests, []), tests)
    hit = checkpointed(hits.groupBy(F.col("digest").alias("_hit_digest")).agg(F.first("spans").alias("_hit_spans")))  # equal texts have equal spans
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _digest(docs["text"]).alias("_of"))
    small, n = _is_small(hit, F.lit(16) if what == "documents" else F.lit(16) + 8 * F.size("_hit_spans"))
    if what == "documents":
        hit = hit.select("_hit_digest")
    on = F.col("_of") == F.col("_hit_digest")
    if small:
        both = rows.join(F.broadcast(hit), on, "left")
    else:
        # Texts that a bitmap of the hit ones passes over stay where they are; copies of a hit text are dealt over its copies.
        may = Bitmap(hit.select(F.xxhash64("_hit_digest").alias("probe")), n).may_hold(F.xxhash64("_of")) & (F.coalesce(F.length("_row.text"), F.lit(0)) > 0)
        asked = rows.where(may).withColumn("_row_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(_copied(hit), on & (F.col("_row_salt") == F.col("_salt")), "left")
        both = asked.drop("_row_salt", "_salt").unionByName(rows.where(~may), allowMissingColumns=True)
    if what == "documents":
        return both.where(F.col("_hit_digest").isNull()).select("_row.*")
    left = F.array_join(F.filter(words(F.col("_row.text")), lambda w, i: ~F.exists("_hit_spans", lambda s: (s["begin"] <= i) & (i < s["end"]))), " ")
    text = F.when(F.col("_hit_digest").isNotNull(), left).otherwise(F.col("_row.text")).alias("text")
    return both.select(*[text if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, 10 AS len, array_to_string(list_slice(w, i, i + 9), ' ') AS words FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION SELECT item, len(w) AS len, array_to_string(w, ' ') AS words FROM b WHERE len(w) BETWEEN 1 AND 9),
lens AS (SELECT DISTINCT len FROM bw),
dw AS (SELECT doc_id, len, i, array_to_string(list_slice(w, i, i + len - 1), ' ') AS words FROM (SELECT doc_id, w, lens.len, unnest(range(1, len(w) - lens.len + 2)) AS i FROM d, lens WHERE len(w) >= lens.len)),
hits AS (SELECT dw.doc_id, dw.i, dw.len, bw.item FROM dw JOIN bw ON dw.len = bw.len AND dw.words = bw.words),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT doc_id, i, len FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
