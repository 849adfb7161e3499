"""Language of whole texts: script ranges, per-word scores, and Viterbi spans with a switching penalty.

A word's scripts narrow the languages it may belong to; each of them scores the word by its count or, for a rare
word, by its letter n-grams; the best path over all words, where a change of language costs SWITCH, labels
spans. The prediction is the language with most letters.

Defined results: a null text and one without letters are ``und`` with score 0; equal scores go to the language
that sorts first; repeated rows get the same result each; an empty table gives no rows; without training rows
every text is ``und``; rows without a doc_id are labelled like others and never held out; extra columns are ignored.
Memory follows the longest text, not the number of languages: the table of known words is bounded in bytes, and the more
languages there are the less text is labelled at once.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.llm.common import CHUNK_BYTES, HashIndex, cut_pieces, lean, text_chunks, tune

#: Bounds of the training sample: documents of each language, characters of one document, documents of all languages, languages (the most frequent ones); parts of a language that are ranked apart.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_TOTAL, MOST_LANGS, SALTS = 768, 16_384, 16_384, 400, 16
#: Cost of a change of language, in nats; most that one word can say for or against a language.
SWITCH, WORD_CAP = 12.0, 6.0
#: Bytes of the table of known words' scores in a worker; bytes of text labelled at once, times languages.
TABLE_BYTES, LABEL_BYTES = 64 << 20, 16 << 20

#: First code points of Unicode script ranges, with the script that starts there.
SCRIPT_STARTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Odia"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"),
    (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
_AT = np.array([a for a, _ in SCRIPT_STARTS])


@functools.cache
def script(ch: str) -> str:
    k = int(np.searchsorted(_AT, ord(ch), side="right")) - 1
    return SCRIPT_STARTS[k][1] if k >= 0 else "Other"


def letters(piece: str) -> str:
    return "".join(ch for ch in piece.lower() if ch.isalpha())


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


@dataclass
class LanguageModel:
    """Scores are log odds against the mean language; scripts: the languages that a script may belong to."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_scores: np.ndarray | None = None
    scripts: dict[str, np.ndarray] = field(default_factory=dict)

    def allowed(self, scripts: frozenset) -> np.ndarray:
        out = np.ones(len(self.langs), bool)
        for s in scripts:
            out &= self.scripts.get(s, True)
        return out if out.any() else np.ones(len(self.langs), bool)

    def score(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score of each language, at most WORD_CAP apart; letters) of each piece."""
        n = len(pieces)
        out, size, masks, mask_of = np.zeros((n, len(self.langs))), np.zeros(n, np.int64), {}, np.zeros(n, np.int64)
        known_at, known, rare_at, rare_len, rare = [], [], [], [], []
        ascii_letters = frozenset({"Latin"})
        for k, x in enumerate(pieces):
            plain = x.isascii()
            w = x if plain and x.isalpha() and x.islower() else letters(x)
            if not w:
                continue
            size[k] = len(w)
            mask_of[k] = masks.setdefault(ascii_letters if plain else frozenset(map(script, w)), len(masks) + 1)
            i = self.words.get(w)
            if i is not None:
                known_at.append(k)
                known.append(i)
            else:
                found = [g for g in map(self.grams.get, grams(w)) if g is not None]
                if found:
                    rare_at.append(k)
                    rare_len.append(len(found))
                    rare += found
        if known:
            out[known_at] = self.word_scores[known]
        if rare:
            lens = np.array(rare_len)
            out[rare_at] = np.add.reduceat(self.gram_scores[rare], np.cumsum(lens) - lens) * np.minimum(1.0, 6 / lens)[:, None]
        table = np.ones((len(masks) + 1, len(self.langs)), bool)
        for scripts, k in masks.items():
            table[k] = self.allowed(scripts)
        out = np.where(table[mask_of], out, -np.inf)
        return np.maximum(out - out.max(1, keepdims=True), -WORD_CAP), size


def train(rows: list[tuple[str, str]]) -> LanguageModel:
    """rows: (lang, text). Counts words and letter n-grams of each language; scores are log odds against the mean language."""
    by: dict[str, Counter] = {}
    for lang, text in rows:
        by.setdefault(lang, Counter()).update(w for w in map(letters, text.split()) if w)
    model = LanguageModel(sorted(k for k, c in by.items() if c))
    n = len(model.langs)
    total = np.array([max(1, sum(by[k].values())) for k in model.langs], float)

    def table(counters: list[Counter], least: int) -> tuple[dict[str, int], np.ndarray]:
        every = Counter()
        for c in counters:
            every.update(c)
        keys = [k for k, count in every.items() if count >= least]
        sums = np.array([sum(c.values()) for c in counters], float)
        s = np.log((np.array([[c[k] for c in counters] for k in keys], float).reshape(-1, n) + 0.5) / (sums + 0.5 * len(every)))
        return {k: i for i, k in enumerate(keys)}, s - s.mean(1, keepdims=True)

    if not n:
        return model
    model.words, model.word_scores = table([by[k] for k in model.langs], 4)
    counted = []
    for k in model.langs:
        c: Counter = Counter()
        for w, times in by[k].items():
            for g in grams(w):
                c[g] += times
        counted.append(c)
    model.grams, model.gram_scores = table(counted, 3)
    seen: dict[str, np.ndarray] = {}
    for i, k in enumerate(model.langs):
        for w, times in by[k].items():
            for s in {script(ch) for ch in w}:
                seen.setdefault(s, np.zeros(n))[i] += times
    model.scripts = {s: share for s, c in seen.items() if (share := c / total >= 0.002).any()}
    return model


def viterbi(scores: list[list[float]], switch: float = SWITCH) -> list[int]:
    """The best language of each word when every change costs ``switch``; ties stay, then go to the first language."""
    if not scores:
        return []
    n = len(scores[0])
    prev, back = list(scores[0]), []
    for row in scores[1:]:
        best = max(prev)
        k = prev.index(best)
        best -= switch
        came, now = [], []
        for i in range(n):
            if prev[i] >= best:
                came.append(i)
                now.append(prev[i] + row[i])
            else:
                came.append(k)
                now.append(best + row[i])
        back.append(came)
        prev = now
    k = prev.index(max(prev))
    path = [k]
    for came in reversed(back):
        k = came[k]
        path.append(k)
    return path[::-1]


class SpanLabeller:
    """Labels the words of many documents at once; scores of words seen before are looked up."""

    def __init__(self, model: LanguageModel, most: int = 1_000_000):
        self.model, self.most = model, min(most, TABLE_BYTES // (4 * max(1, len(model.langs))))
        self._reset()

    def _reset(self):
        self.known = HashIndex()
        room = min(1 << 16, self.most)
        self.table, self.size = np.zeros((room, len(self.model.langs)), np.float32), np.zeros(room, np.int32)

    def _slots(self, words: pa.Array, keys: np.ndarray) -> np.ndarray:
        if self.known.size + len(words) > self.most:
            self._reset()
        slot = self.known.find(keys)
        if (new := slot < 0).any():
            a, z = self.known.size, self.known.size + int(new.sum())
            while z > len(self.table):
                self.table, self.size = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.size, np.zeros_like(self.size)])
            self.table[a:z], self.size[a:z] = self.model.score([w.decode("utf-8").strip() for w in words.filter(pa.array(new)).to_pylist()])
            self.known.add(keys[new])
            slot[new] = np.arange(a, z)
        return slot

    def __call__(self, offs: np.ndarray, data: np.ndarray):
        """For each document (lang index or -1, score, [(lang index, first piece, behind last piece)])."""
        docs, n = len(offs) - 1, len(data)
        none = [(-1, 0.0, [])] * docs
        if n == 0 or not self.model.langs:
            return none
        cuts, words, index, keys = cut_pieces(offs, data)
        slot = self._slots(words, keys)[index]
        s, size, edge = self.table[slot].astype(float), self.size[slot].astype(np.int64), np.searchsorted(cuts, offs)
        sums = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s, axis=0)])
        total = sums[edge[1:]] - sums[edge[:-1]]
        best = total.argmax(1)
        chars = np.concatenate([[0], np.cumsum(size)])
        chars = chars[edge[1:]] - chars[edge[:-1]]
        # One language is the best path if no run of words favours another one by more than a switch costs.
        doc_of = np.repeat(np.arange(docs), np.diff(edge))
        gain = s - s[np.arange(len(s)), best[doc_of]][:, None]
        after = np.cumsum(gain, axis=0)
        lens = np.diff(edge)
        # Sums begin anew with each document, shifted by what words can add, so that they lie below all before it.
        shift = np.concatenate([[0], np.cumsum(2 * WORD_CAP * (lens[:-1] + lens[1:] + 2))]) if docs else np.zeros(0)
        before = np.concatenate([np.zeros((1, s.shape[1])), after])[edge[:-1]] + shift[:, None]
        after -= before[doc_of]
        lowest = np.minimum.accumulate(after - gain, axis=0)
        mixed_word = ((after - lowest).max(1) > SWITCH - 1e-6) if len(s) else np.zeros(0, bool)
        mixed = np.bincount(doc_of[mixed_word], minlength=docs) > 0
        out = []
        for d in range(docs):
            if chars[d] == 0:
                out.append((-1, 0.0, []))
            elif not mixed[d]:
                rest = total[d] - total[d].max()
                out.append((int(best[d]), float(1 / np.exp(np.maximum(rest, -700)).sum()), [(int(best[d]), 0, int(edge[d + 1] - edge[d]))]))
            else:
                rows, width = s[edge[d] : edge[d + 1]].tolist(), size[edge[d] : edge[d + 1]]
                path = np.array(viterbi(rows))
                cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
                share = np.bincount(path, weights=width, minlength=s.shape[1]) / chars[d]
                k = int(share.argmax())
                out.append((k, float(share[k]), [(int(path[a]), int(a), int(z)) for a, z in zip(cut[:-1], cut[1:], strict=True)]))
        return out


_SPANS = "array<struct<lang:string,first_piece:int,end_piece:int>>"


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are runs of pieces (common.cut_pieces) of one language."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    names = [*model.langs, "und"]

    chunk = min(CHUNK_BYTES, LABEL_BYTES // max(1, len(model.langs)))

    def run(batches):
        label = SpanLabeller(shared.value)
        for batch in batches:
            for ids, offs, data in text_chunks(batch, limit=chunk):
                found = label(offs, data)
                spans = [[{"lang": names[k], "first_piece": a, "end_piece": z} for k, a, z in f[2]] for f in found]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first_piece", pa.int32()), ("end_piece", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([names[f[0]] for f in found], pa.string()), pa.array([min(1.0, max(0.0, f[1])) for f in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, spans {_SPANS}")


def training_rows(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """A sample bounded for each language, in an order of hashes; docs: (doc_id, text, lang).

    train_docs of each language, fewer where there are many languages: TRAIN_TOTAL at most of all. Ids alone are
    ranked, in SALTS parts of each language; their texts are fetched by a broadcast of these few.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS) & (F.length("text") > 0))
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    langs = [r["lang"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()]
    each = min(train_docs, TRAIN_TOTAL // max(1, len(langs)))
    ranked = ids.where(F.col("lang").isin(langs)).withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h", "doc_id")))
    few = ranked.where(F.col("rank") <= math.ceil(each / SALTS)).select("doc_id")
    return [(r.lang, r.text) for r in usable.join(F.broadcast(few), "doc_id", "left_semi").select("lang", "text").collect()]


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = train(training_rows(docs.where(rest != 2)))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
