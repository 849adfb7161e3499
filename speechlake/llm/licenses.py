"""License scans by patience alignment.

Words that occur once in a text's window and in a template are anchors, the longest increasing run of them is kept, and
the gaps between are aligned the same way. A hit is a window whose alignment covers COVERAGE of the template's words and
is DENSITY of the window's. Every word of NAMING that a template has must be aligned, and no other of them, nor any word behind "GNU", may stand unaligned
within the window: a look-alike's name, version or terms make another license. Places are found in two ways: first where three words in a row also stand in a template,
which finds plain notices at once; then, of what that leaves, wherever as many of the template's words as a hit needs
lie as close together as a hit allows, every window is aligned, so that no altered, swapped or interrupted notice within
the bounds is missed; a place is aligned only where the longest common subsequence allows a hit. Of hits that overlap the
one with the most aligned words counts, then the best covered, then the first: a notice of three clauses is not one of two.
"reserved" is a notice, no license.

Defined results: null and empty texts have no licenses; several places of one license count each; of windows that begin
alike the best covered counts, then the shortest; repeated rows get the same result each; an empty table gives no rows;
a null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import LOWER, lean, mix64, runs, text_chunks, tune, word_hashes

#: Least share of a template that must be aligned, and of the words between the first and last aligned one.
COVERAGE, DENSITY = 0.8, 0.6

#: Wordings of public license notices, by license.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
]
#: Words that tell one license's name, version or terms from another's.
NAMING = frozenset("0 1 2 3 4 5 affero apache attribution bsd cc commons creative eclipse gnu lesser mit mozilla nc nd noderivatives noderivs noncommercial sa sharealike unencumbered unported".split())

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def words_of(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of each document, borders); words are runs of ASCII letters, digits and other bytes above them, a-z as A-Z."""
    data = LOWER[data]
    starts, ends, count = runs(_WORD[data], offs)
    return word_hashes(data, starts, ends), np.concatenate([[0], np.cumsum(count)])


def _seeds(h: np.ndarray) -> np.ndarray:
    return mix64(h[:-2] * _MULT[0] + h[1:-1] * _MULT[1] + h[2:] * _MULT[2]) if len(h) > 2 else np.zeros(0, np.uint64)


def common_bound(a: list, places: dict, size: int):
    """After each word of a, the length of the longest common subsequence with a template (bit-parallel); places: the template's bits of each word."""
    full = (1 << size) - 1
    v = full
    for w in a:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
        yield size - v.bit_count()


def patience(a: list, b: list, a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned positions of two word lists, ascending in both."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i + a0, k + b0))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            out.append((j - 1 + a0, m - 1 + b0))
            j, m = j - 1, m - 1
        if i >= j or k >= m:
            continue
        once_a, once_b = _once(a, i, j), _once(b, k, m)
        shared = sorted((p, once_b[w]) for w, p in once_a.items() if w in once_b)
        run = _increasing(shared)
        if not run:
            continue
        edges = [(i - 1, k - 1), *run, (j, m)]
        out += [(p + a0, q + b0) for p, q in run]
        stack += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def _once(x: list, i: int, j: int) -> dict:
    seen: dict = {}
    for p in range(i, j):
        seen[x[p]] = p if x[p] not in seen else -1
    return {w: p for w, p in seen.items() if p >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, ascending in the first, that ascends in the second too (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, q) in enumerate(pairs):
        k = bisect_left(tops, q)
        back[n] = at[k - 1] if k else -1
        tops[k : k + 1], at[k : k + 1] = [q], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


@dataclass
class LicenseScanner:
    templates: list[tuple[str, str]]
    naming_words: frozenset[str] = NAMING

    def __post_init__(self):
        self.names, self.words, seeds, owner, offset = [], [], [], [], []
        for k, (name, text) in enumerate(self.templates):
            raw = text.encode()
            h, _ = words_of(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
            if len(h) < 3:
                raise ValueError(f"a template needs three words: {text!r}")
            self.names.append(name)
            self.words.append(h.tolist())
            s = _seeds(h)
            seeds.append(s)
            owner.append(np.full(len(s), k))
            offset.append(np.arange(len(s)))
        seeds, owner, offset = np.concatenate(seeds), np.concatenate(owner), np.concatenate(offset)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.offset = seeds[order], owner[order], offset[order]
        self.known = np.unique(np.concatenate([np.array(w, np.uint64) for w in self.words]))
        naming = {w: int(x) for w, x in ((w, words_of(np.array([0, len(w)]), np.frombuffer(w.encode(), np.uint8))[0][0]) for w in self.naming_words)}
        self.naming, self.gnu = set(naming.values()), naming.get("gnu")
        self.needed = [self.naming & set(w) for w in self.words]
        self.bits = [{x: sum(1 << q for q, y in enumerate(w) if y == x) for x in set(w)} for w in self.words]
        self.member = np.stack([np.isin(self.known, np.array(w, np.uint64)) for w in self.words])

    def __call__(self, offs: np.ndarray, data: np.ndarray) -> dict[int, list[tuple[str, float, int, int]]]:
        """Of each document with licenses: (license, coverage, first word, behind last word)."""
        h, edge = words_of(offs, data)
        seeds = _seeds(h)
        low, high = np.searchsorted(self.seeds, seeds, side="left"), np.searchsorted(self.seeds, seeds, side="right")
        at = np.flatnonzero(high > low)
        doc = np.searchsorted(edge, at, side="right") - 1
        inside = at + 2 < edge[doc + 1]
        at, doc = at[inside], doc[inside]
        places: dict[tuple[int, int], list[tuple[int, list[int]]]] = {}
        for p, d in zip(at.tolist(), doc.tolist(), strict=True):
            here: dict[int, list[int]] = {}
            for k, q in zip(self.owner[low[p] : high[p]].tolist(), self.offset[low[p] : high[p]].tolist(), strict=True):
                here.setdefault(k, []).append(q)
            for k, qs in here.items():
                places.setdefault((d, k), []).append((p, sorted(qs)))
        out: dict[int, list] = {}
        for (d, k), found in places.items():
            begin, end = int(edge[d]), int(edge[d + 1])
            for coverage, first, behind in self._hits(h, k, begin, end, self._windows(found, len(self.words[k]))):
                out.setdefault(d, []).append((k, coverage, first, behind))
        for d, k, part in self._crowds(h, edge):
            taken = sorted((x[2], x[3]) for x in out.get(d, ()) if x[0] == k)
            for positions in self._between(part, taken):
                out.setdefault(d, []).extend((k, *hit) for hit in self._search(h, k, positions))
        return {d: [(self.names[k], c, first - int(edge[d]), behind - int(edge[d])) for k, c, first, behind in self._best(hits)] for d, hits in out.items() if hits}

    def _best(self, hits: list[tuple[int, float, int, int]]) -> list[tuple[int, float, int, int]]:
        """The hits, by place, that no better one overlaps."""
        kept: list[tuple[int, int]] = []
        out = []
        for hit in sorted(hits, key=lambda x: (-round(x[1] * len(self.words[x[0]])), -x[1], x[2], x[3], x[0])):
            at = bisect_left(kept, (hit[2], hit[3]))
            if (at == len(kept) or kept[at][0] >= hit[3]) and (at == 0 or kept[at - 1][1] <= hit[2]):
                kept.insert(at, (hit[2], hit[3]))
                out.append(hit)
        return sorted(out, key=lambda x: x[2:])

    def _fits(self, h: np.ndarray, k: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether an alignment with template k is a hit."""
        words = self.words[k]
        if not pairs or len(pairs) < COVERAGE * len(words) or len(pairs) < DENSITY * (pairs[-1][0] + 1 - pairs[0][0]):
            return False
        aligned = {p for p, _ in pairs}
        own = {words[q] for _, q in pairs}
        if not self.needed[k] <= own:
            return False
        strange = self.naming - self.needed[k]
        for p in range(pairs[0][0], pairs[-1][0] + 1):
            if p not in aligned and (int(h[p]) in strange or (p - 1 in aligned and int(h[p - 1]) == self.gnu)):
                return False
        return True

    def _crowds(self, h: np.ndarray, edge: np.ndarray):
        """(document, template, places of its words) wherever as many of them as a hit needs lie within the longest window of a hit."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == h)
        word = at[place]
        for k, words in enumerate(self.words):
            need, reach = ceil(COVERAGE * len(words) - 1e-9), int(len(words) / DENSITY + 1e-9)
            mine = place[self.member[k][word]]
            if len(mine) < need:
                continue
            start = np.flatnonzero(mine[need - 1 :] - mine[: len(mine) - need + 1] < reach)
            start = start[np.searchsorted(edge, mine[start], side="right") == np.searchsorted(edge, mine[start + need - 1], side="right")]
            if not len(start):
                continue
            first = np.flatnonzero(np.concatenate([[True], np.diff(start) >= need]))
            doc = np.searchsorted(edge, mine[start], side="right") - 1
            first = np.union1d(first, np.flatnonzero(np.diff(doc)) + 1)
            for a, z in zip(first, np.append(first[1:], len(start)) - 1, strict=True):
                yield int(doc[a]), k, mine[start[a] : start[z] + need].tolist()

    @staticmethod
    def _between(positions: list[int], taken: list[tuple[int, int]]) -> list[list[int]]:
        """The positions outside what is taken, cut where something taken lies between."""
        parts: list[list[int]] = [[]]
        k = 0
        for p in positions:
            while k < len(taken) and taken[k][1] <= p:
                k += 1
                parts.append([])
            if k == len(taken) or p < taken[k][0]:
                parts[-1].append(p)
        return [x for x in parts if x]

    def _search(self, h: np.ndarray, k: int, positions: list[int]) -> list[tuple[float, int, int]]:
        """(coverage, first word, behind last word) of hits among these places of the template's words: of the windows that begin at the first place where one is a hit the best covered, the shortest of those; then behind it.

        Starts are passed over by the bound of a window that holds all of theirs, then by that of their own; ends by how far the bound has come.
        """
        words, bits = self.words[k], self.bits[k]
        size, need, reach = len(words), ceil(COVERAGE * len(words) - 1e-9), int(len(words) / DENSITY + 1e-9)
        hits, own = [], [int(h[p]) for p in positions]
        s, clear = 0, 0
        while s < len(positions):
            if s >= clear:
                # no window that begins within the next reach words can be a hit where all of them together have too little in common
                ahead = bisect_left(positions, positions[s] + reach, s)
                end = bisect_left(positions, positions[s] + 2 * reach, s)
                if max(common_bound(own[s:end], bits, size), default=0) < need:
                    s = ahead
                    continue
                clear = ahead
            end = bisect_left(positions, positions[s] + reach, s)
            best, a = None, positions[s]
            for e, bound in enumerate(common_bound(own[s:end], bits, size), s):
                if bound < need or (best is not None and bound <= best[0]):
                    continue
                pairs = patience(h[a : positions[e] + 1].tolist(), words, a)
                if self._fits(h, k, pairs) and (best is None or len(pairs) > best[0]):
                    best = (len(pairs), pairs[0][0], pairs[-1][0] + 1)
            if best:
                hits.append((best[0] / size, best[1], best[2]))
                s = bisect_left(positions, best[2], s)
                clear = s
                continue
            s += 1
        return hits

    def _hits(self, h: np.ndarray, k: int, begin: int, end: int, windows: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
        """(coverage, first word, behind last word). Each window alone, up to its neighbours' seeds; then those in a row that gave nothing, together."""
        words, hits = self.words[k], []
        size = len(words)

        def align(n: int, m: int) -> bool:
            a = max(begin, windows[n][0] - size, windows[n - 1][1] + 3 if n else begin)
            z = min(end, windows[m][1] + 3 + size, windows[m + 1][0] if m + 1 < len(windows) else end)
            pairs = patience(h[a:z].tolist(), words, a)
            if not self._fits(h, k, pairs):
                return False
            hits.append((len(pairs) / size, pairs[0][0], pairs[-1][0] + 1))
            return True

        free = [not align(n, n) for n in range(len(windows))]
        n = 0
        while n < len(windows):
            m = n + 1
            # no hit is longer than size / DENSITY words
            while free[n] and m < len(windows) and free[m] and windows[m][0] - windows[n][1] - 3 <= size / DENSITY:
                if align(n, m):
                    n = m
                    break
                m += 1
            n += 1
        return hits

    @staticmethod
    def _windows(found: list[tuple[int, list[int]]], size: int) -> list[tuple[int, int]]:
        """(first seed, last seed) of each place: a new one begins behind a gap, and where the template's words begin again."""
        out, last, at = [], -1, -1
        for p, offsets in found:
            onward = [q for q in offsets if q > at]
            if not out or p - last > size or not onward:
                out.append((p, p))
                at = offsets[0]
            else:
                out[-1] = (out[-1][0], p)
                at = min(onward)
            last = p
        return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hits) of every document; hits: array of (license, coverage, first_word, end_word) by place."""
    tune(docs.sparkSession)
    templates = templates or TEMPLATES
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches):
        scan = LicenseScanner(templates)
        for batch in batches:
            for ids, offs, data in text_chunks(batch):
                found = scan(offs, data)
                rows = [[dict(zip(("license", "coverage", "first_word", "end_word"), x, strict=True)) for x in sorted(found.get(d, ()), key=lambda x: (x[2], x[3], x[0]))] for d in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows, kind)], ["doc_id", "hits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, hits array<struct<license:string,coverage:double,first_word:bigint,end_word:bigint>>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.array_join(F.array_sort(F.array_distinct(F.col("hits.license"))), ",").alias("licenses"), F.coalesce(F.array_max("hits.coverage"), F.lit(0.0)).alias("best_coverage"))
