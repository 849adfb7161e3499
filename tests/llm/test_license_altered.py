"""op1: altered notices against an alignment of every window, written apart from the operator."""

import random
import re

import numpy as np

from speechlake.llm.licenses import COVERAGE, DENSITY, TEMPLATES, LicenseScanner


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def aligned(a, b):
    """Pairs of patience alignment, by its definition: ends that agree, then words that occur once in both, then the gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in aligned(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return aligned(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(a.index(w), b.index(w)) for w in a if a.count(w) == 1 and b.count(w) == 1]
    best = []  # longest increasing run, by trying all ends
    runs = []
    for p, q in once:
        run = max((r for r in runs if r[-1][1] < q), key=len, default=[]) + [(p, q)]
        runs.append(run)
        best = max(best, run, key=len)
    if not best:
        return []
    out, edges = list(best), [(-1, -1), *best, (len(a), len(b))]
    for (i, j), (m, n) in zip(edges, edges[1:]):
        out += [(x + i + 1, y + j + 1) for x, y in aligned(a[i + 1 : m], b[j + 1 : n])]
    return sorted(out)


def best_window(text, notice):
    """The best coverage of any window that is a hit."""
    t, n, best = words(text), words(notice), 0.0
    for a in range(len(t)):
        if t[a] not in n:
            continue
        for z in range(a + 1, min(len(t), a + int(len(n) / DENSITY)) + 1):
            pairs = aligned(t[a:z], n)
            if pairs and len(pairs) >= COVERAGE * len(n) - 1e-9 and len(pairs) >= DENSITY * (pairs[-1][0] + 1 - pairs[0][0]):
                best = max(best, len(pairs) / len(n))
    return best


def scan(text, templates=TEMPLATES):
    """Hits by alignment alone, whatever words name a license (test_license_lookalikes.py has these)."""
    raw = text.encode()
    return LicenseScanner(templates, frozenset())(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).get(0, [])


def test_altered_notices_as_found_by_every_window():
    rng = random.Random(4)
    short = [t for t in TEMPLATES if len(words(t[1])) <= 16]
    found_some = missed_some = 0
    for _ in range(250):
        name, notice = rng.choice(short)
        w = words(notice)
        for _ in range(rng.randrange(5)):
            k, what = rng.randrange(len(w)), rng.randrange(4)
            if what == 0:
                w[k] = "other"
            elif what == 1:
                w.insert(k, rng.choice(["very", "the", w[k]]))
            elif what == 2 and len(w) > 2:
                del w[k]
            else:
                j = rng.randrange(len(w))
                w[k], w[j] = w[j], w[k]
        around = ["see", "the", "license", "of", "this", "work", "and", "more"]
        text = " ".join(rng.choices(around, k=3) + w + rng.choices(around, k=4))
        want, got = best_window(text, notice), scan(text, [(name, notice)])
        assert bool(want) == bool(got), (text, notice, want, got)
        found_some += bool(want)
        missed_some += not want
        for _, coverage, first, behind in got:
            pairs = aligned(words(text)[first:behind], words(notice))
            assert coverage >= COVERAGE - 1e-9 and len(pairs) >= DENSITY * (behind - first)
    assert found_some > 80 and missed_some > 20


def test_notices_without_three_words_in_a_row():
    for text in ("Released under a MIT License.", "Released under MIT the License.", "All rights are reserved", "all my rights are reserved here"):
        assert scan(text), text
    assert not scan("all of the rights that we have are not reserved")


def test_long_notices_with_every_fifth_word_changed():
    for name, notice in TEMPLATES:
        w = words(notice)
        if len(w) >= 20:
            altered = [x if k % 6 != 2 else "changed" for k, x in enumerate(w)]
            assert name in [x[0] for x in scan("before " + " ".join(altered) + " behind")], notice


def test_templates_words_without_a_notice():
    text = "the license the work the terms of the software " * 400
    assert scan(text) == []
