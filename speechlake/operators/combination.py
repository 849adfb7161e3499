"""Combining the hypotheses of several models: a word transition network, voted slot by slot, with confidences.

The models' word lists are aligned one after another into a network of slots, by the order of their names. A slot holds
what each model says there, a word or nothing. A new list meets the network at the least cost: a word costs nothing in a
slot where any model has said it, SUBSTITUTION in another, INSERTION as a slot of its own between two; passing over a slot
costs nothing where some model said nothing, DELETION elsewhere. Of equally cheap ways the one is taken that, from the end, puts a
word into a slot rather than passing over the slot, and passes over the slot rather than making a new one.

A slot's word is the one with the highest vote, ALPHA of the share of the models' weights that say it and the rest of its
mean confidence; nothing has the confidence NOTHING. Ties go to the word that the first model by name says, of those tied.
The confidence of a text is the mean over its slots of what won.

Costs are whole numbers, so that no rounding decides; order matters in the alignment, and is the names', whatever the order
of rows. Defined results: a model without a hypothesis for a key says nothing, not even an empty text, and has no vote;
a null hypothesis is an empty text; of several hypotheses of a model for a key the last by its text counts; a key without
hypotheses has no row. A key gathers one row for each model; a text is aligned in time of its length times the network's
and memory of the network's length times the square root of the text's. Keys of a batch whose texts are short take each step together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.session import ship_code

SUBSTITUTION, INSERTION, DELETION = 4, 3, 3
ALPHA, NOTHING = 0.5, 0.7
#: Slots times words up to which all ways of an alignment are held at once.
SMALL = 1 << 20
#: Cells of a table that keys fill together.
CELLS = 1 << 22
_NONE, _PAD = -1, -2


@dataclass
class Network:
    """slots[k]: {model: word, or None where it says nothing}."""

    slots: list[dict[int, str | None]] = field(default_factory=list)
    models: list[int] = field(default_factory=list)

    def add(self, model: int, words: list[str]) -> None:
        """Align one model's words with all that came before."""
        n, m = len(self.slots), len(words)
        if not self.models:
            self.slots = [{model: w} for w in words]
            self.models.append(model)
            return
        free = np.array([None in s.values() for s in self.slots], bool)
        said: dict[str, list[int]] = {}
        for k, s in enumerate(self.slots):
            for w in set(s.values()):
                if w is not None:
                    said.setdefault(w, []).append(k)
        skip = np.where(free, 0, DELETION).astype(np.int64)
        # row j: cost of meeting the first k slots with the first j words; passing slots adds up, so that a running minimum gives it
        passed = np.concatenate([[0], np.cumsum(skip)])

        def step(row: np.ndarray, w: str) -> tuple[np.ndarray, np.ndarray]:
            """The next row, and its ways: 1 into a slot, 2 passes a slot, 3 a new slot."""
            cost = np.full(n, SUBSTITUTION, np.int64)
            cost[said.get(w, [])] = 0
            into = np.concatenate([[np.iinfo(np.int64).max // 4], row[:-1] + cost])
            after = np.minimum.accumulate(np.minimum(into, row + INSERTION) - passed) + passed
            passes = np.concatenate([[False], after[:-1] + skip == after[1:]])
            return after, np.where(into == after, 1, np.where(passes, 2, 3)).astype(np.uint8)

        # every stride-th row is kept, and the ways of one stride at a time
        small = m * n <= SMALL
        stride = m + 1 if small else isqrt(m) + 1
        kept, row, ways = [passed], passed, []
        for j, w in enumerate(words, 1):
            row, own = step(row, w)
            if small:
                ways.append(own)
            elif j % stride == 0:
                kept.append(row)
        out, k, j, low = [], n, m, 1 if small else m + 1
        while k or j:
            if not j:
                way = 2
            else:
                if j < low:
                    low = (j - 1) // stride * stride + 1
                    row, ways = kept[low // stride], []
                    for w in words[low - 1 : j]:
                        row, own = step(row, w)
                        ways.append(own)
                way = ways[j - low][k]
            if way == 1:
                k, j = k - 1, j - 1
                out.append(self.slots[k] | {model: words[j]})
            elif way == 2:
                k -= 1
                out.append(self.slots[k] | {model: None})
            else:
                j -= 1
                out.append({x: None for x in self.models} | {model: words[j]})
        self.slots = out[::-1]
        self.models.append(model)


def vote(slot: dict[int, str | None], weights: dict[int, float], confidence: dict[int, float], alpha: float = ALPHA, nothing: float = NOTHING) -> tuple[str | None, float]:
    """The winner of a slot and its score."""
    total = sum(weights[m] for m in sorted(slot))
    by: dict[str | None, list[int]] = {}
    for m in sorted(slot):
        by.setdefault(slot[m], []).append(m)
    best, score = None, -1.0
    for w, who in by.items():  # in the order of the first model that says it
        sure = nothing if w is None else sum(confidence[m] for m in who) / len(who)
        s = alpha * sum(weights[m] for m in who) / total + (1 - alpha) * sure if total else 0.0
        if s > score + 1e-12:
            best, score = w, s
    return best, score


def combine_texts(names: list[str], texts: list[str], weights: list[float], confidence: list[float], alpha: float = ALPHA, nothing: float = NOTHING) -> tuple[str, float, list[tuple[str | None, float]]]:
    """(combined text, its confidence, winner and score of each slot) of one key's hypotheses."""
    last: dict[str, int] = {}
    for k in sorted(range(len(names)), key=lambda k: (names[k], texts[k], weights[k], confidence[k])):
        last[names[k]] = k
    who = [last[x] for x in sorted(last)]
    network = Network()
    for place, k in enumerate(who):
        network.add(place, texts[k].split())
    w, c = {p: weights[k] for p, k in enumerate(who)}, {p: confidence[k] for p, k in enumerate(who)}
    won = [vote(s, w, c, alpha, nothing) for s in network.slots]
    text = " ".join(x for x, _ in won if x is not None)
    sure = float(np.mean([s for _, s in won])) if won else 1.0
    return text, sure, won


def _grow(slots: np.ndarray, n: np.ndarray, words: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Network.add for many keys at once: (slots, their number). slots: (model, slot, key) codes, _NONE where a model says nothing; words: (word, key)."""
    k, wide, long = len(n), int(n.max(initial=0)), int(m.max(initial=0))
    slots = slots[:, :wide]
    skip = np.where((slots == _NONE).any(0), 0, DELETION).astype(np.int32)
    passed = np.concatenate([np.zeros((1, k), np.int32), np.cumsum(skip, axis=0, dtype=np.int32)])
    row, ways, far = passed, np.zeros((long, wide + 1, k), np.uint8), np.full((1, k), np.iinfo(np.int32).max // 4, np.int32)
    for j in range(long):
        cost = np.where((slots == words[j]).any(0), 0, SUBSTITUTION).astype(np.int32)
        into = np.concatenate([far, row[:-1] + cost])
        after = np.minimum.accumulate(np.minimum(into, row + INSERTION) - passed, axis=0) + passed
        ways[j] = 3
        ways[j, 1:][after[:-1] + skip == after[1:]] = 2
        ways[j][into == after] = 1
        row = after
    # the way back of all keys at once; a step gives a slot the old one it comes from, and its word
    key, i, j, found = np.arange(k), n.copy(), m.copy(), []
    while True:
        on = (i > 0) | (j > 0)
        key, i, j = key[on], i[on], j[on]
        if not len(key):
            break
        way = np.where(j > 0, ways[np.maximum(j - 1, 0), i, key] if long else 2, 2)
        i, j = i - (way != 3), j - (way != 2)
        word = words[np.minimum(j, long - 1), key] if long else _NONE
        found.append((key, np.where(way == 3, -1, i), np.where(way == 2, _NONE, word)))
    length = np.zeros(k, np.int64)
    for t, (key, _, _) in enumerate(found):
        length[key] = t + 1
    out = np.full((len(slots) + 1, len(found), k), _PAD, np.int32)
    for t, (key, old, word) in enumerate(found):
        at = length[key] - 1 - t
        out[:-1, at, key] = np.where(old >= 0, slots[:, old, key] if wide else _NONE, _NONE)
        out[-1, at, key] = word
    return out, length


def _added(parts: np.ndarray) -> np.ndarray:
    """Sums over the first axis as Python's sum() gives them, what rounding loses carried along."""
    total, lost = parts[0], np.zeros_like(parts[0])
    for x in parts[1:]:
        t = total + x
        lost, total = lost + np.where(np.abs(total) >= np.abs(x), (total - t) + x, (x - t) + total), t
    return total + lost


def _votes(slots: np.ndarray, weights: np.ndarray, confidence: np.ndarray, alpha: float, nothing: float) -> tuple[np.ndarray, np.ndarray]:
    """vote() of every slot of many keys: (winner, score). weights, confidence: (model, key)."""
    total = _added(weights)
    best, score = np.full(slots.shape[1:], _NONE, np.int32), np.full(slots.shape[1:], -1.0)
    for a, word in enumerate(slots):
        same = slots == word
        weight, sure = (_added(same * of[:, None, :]) for of in (weights, confidence))
        sure = np.where(word == _NONE, nothing, sure / same.sum(0))
        s = np.where(total != 0, alpha * weight / np.where(total != 0, total, 1.0) + (1 - alpha) * sure, 0.0)
        better = (s > score + 1e-12) & ~same[:a].any(0)
        best, score = np.where(better, word, best), np.where(better, s, score)
    return best, score


def combine_batch(said: pa.Array, alpha: float = ALPHA, nothing: float = NOTHING) -> list[pa.Array]:
    """[n_models, hyp, confidence, words] of each key. said: lists of (model, hyp, weight, confidence), of each model one, by their names."""
    flat, many = said.flatten(), np.array(said.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    first = np.concatenate([[0], np.cumsum(many)])
    split = [x.split() for x in flat.field("hyp").to_pylist()]
    weights, sure = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("weight", "confidence"))
    lens = np.fromiter(map(len, split), np.int64, len(split))
    book: dict[str, int] = {}
    codes = np.fromiter((book.setdefault(w, len(book)) for x in split for w in x), np.int32, int(lens.sum()))
    at = np.concatenate([[0], np.cumsum(lens)])
    size = at[first[1:]] - at[first[:-1]]  # no network gets longer
    rows, winners, scores, lengths = [], [], [], []

    def done(keys: np.ndarray, best: np.ndarray, score: np.ndarray, n: np.ndarray) -> None:
        inside = (np.arange(best.shape[0])[:, None] < n).T
        rows.append(keys), lengths.append(n), winners.append(best.T[inside]), scores.append(score.T[inside])

    order = np.lexsort((size, many))
    begin = 0
    while begin < len(order):
        some = order[begin : begin + 4096]
        room = np.arange(1, len(some) + 1) * (size[some] + 1) ** 2
        some = some[: max(1, min(int(np.searchsorted(room, CELLS, side="right")), int(np.searchsorted(many[some], many[some[0]], side="right"))))]
        begin += len(some)
        if room[0] > CELLS:  # alone
            k = some[0]
            models, (a, z) = range(int(many[k])), first[k : k + 2]
            names = [f"{m:09d}" for m in models]
            won = combine_texts(names, [" ".join(x) for x in split[a:z]], weights[a:z].tolist(), sure[a:z].tolist(), alpha, nothing)[2]
            done(some, np.array([[_NONE if w is None else book[w]] for w, _ in won], np.int32).reshape(-1, 1), np.array([[s] for _, s in won]).reshape(-1, 1), np.array([len(won)]))
            continue
        slots, n = None, None
        for p in range(int(many[some[0]])):
            text = first[some] + p
            m = lens[text]
            place = np.arange(int(m.max(initial=0)))[:, None]
            words = np.full((len(place), len(some)), _PAD, np.int32)
            inside = place < m
            words[inside] = codes[(at[text] + place)[inside]]
            slots, n = (words[None], m) if slots is None else _grow(slots, n, words, m)
        texts = first[some] + np.arange(int(many[some[0]]))[:, None]
        best, score = _votes(slots, weights[texts], sure[texts], alpha, nothing)
        done(some, best, score, n)
    # back into the keys' order
    n, best, score = np.zeros(len(many), np.int64), np.zeros(0, np.int32), np.zeros(0)
    if rows:
        row = np.concatenate(rows)
        n[row] = np.concatenate(lengths)
        back = np.argsort(np.repeat(row, np.concatenate(lengths)), kind="stable")
        best, score = np.concatenate(winners)[back], np.concatenate(scores)[back]
    border = np.concatenate([[0], np.cumsum(n)])
    names, spoken = pa.array(list(book), pa.string()), best >= 0
    word = names.take(pa.array(best, mask=~spoken))
    words = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.StructArray.from_arrays([word, pa.array(score)], ["word", "score"]))
    heard = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spoken)])[border], pa.int32()), names.take(pa.array(best[spoken])))
    means = [np.add.reduce(score[a:z]) / (z - a) if z > a else 1.0 for a, z in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]
    return [pa.array(many, pa.int32()), pc.binary_join(heard, " "), pa.array(means, pa.float64()), words]


def combine(preds: DataFrame, key: str = "utt_id", model: str = "model_id", hyp: str = "hyp", weight: Column | None = None, confidence: Column | None = None, alpha: float = ALPHA, nothing: float = NOTHING) -> DataFrame:
    """(key, n_models, hyp, confidence, words) of every key; words: array of (word, score), a null word where nothing won. weight and confidence: columns of preds, 1 where null or not given."""
    ship_code(preds.sparkSession)
    kind = dict(preds.dtypes)[key]
    one = F.lit(1.0)
    said = F.struct(F.coalesce(F.col(hyp), F.lit("")).alias("hyp"), F.coalesce(weight.cast("double"), one).alias("weight") if weight is not None else one.alias("weight"), F.coalesce(confidence.cast("double"), one).alias("confidence") if confidence is not None else one.alias("confidence"))
    # one row of each model reaches a key, however often a row is repeated
    own = preds.where(F.col(key).isNotNull() & F.col(model).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(model).cast("string").alias("_model")).agg(F.max(said).alias("said"))
    each = own.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(F.col("_model").alias("model"), "said.*"))).alias("said"))
    result = f"_key {kind}, n_models int, hyp string, confidence double, words array<struct<word:string,score:double>>"

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *combine_batch(batch.column(1), alpha, nothing)], ["_key", "n_models", "hyp", "confidence", "words"])

    return each.mapInArrow(run, result).withColumnRenamed("_key", key)


def confident(combined: DataFrame, least: float) -> DataFrame:
    """Rows of combine() whose confidence reaches ``least``."""
    return combined.where(F.col("confidence") >= least)
