"""Long rows of a batch take each step together, near the straight line, and no edit differs from the whole table's."""

import random

import pyarrow as pa
import pytest
from test_alignment import lists, plain

from speechlake.functions import alignment as A


def whole(ref, hyp):
    """The distance by the whole table."""
    up, down = A._columns(A._places(ref), len(ref), hyp, (1 << len(ref)) - 1, 0) if ref else (0, 0)
    return len(hyp) + up.bit_count() - down.bit_count()


def pairs(seed, n, count):
    """Texts with few and many edits, gaps on one side, others in no way alike, and equal and empty ones."""
    rng = random.Random(seed)
    for k in range(count):
        ref = [rng.choice("abcdefghij ") for _ in range(rng.randrange(n * 3 // 4, n))]
        share = rng.choice((0.01, 0.05, 0.2))
        hyp = [x for t in ref for x in ([] if rng.random() < share else [t] if rng.random() > share else [t, "x"])]
        at = rng.randrange(len(hyp))
        kind = k % 8
        yield ref, (hyp[: at // 2] + hyp[at:] if kind == 1 else hyp[at:] + hyp[:at] if kind == 2 else [rng.choice("klmno") for _ in hyp] if kind == 3 else ref if kind == 4 else [] if kind == 5 else hyp)


@pytest.mark.parametrize("seed,n,near", [(1, 1800, 256), (2, 700, 16), (3, 300, 0), (4, 1800, 0)])
def test_distances_of_long_rows(monkeypatch, seed, n, near):
    monkeypatch.setattr(A, "_NEAR", near)
    rows = list(pairs(seed, n, 120))
    got = A.count_chars(*(pa.array(["".join(x) for x in side]) for side in zip(*rows, strict=True))).to_pylist()
    assert got == [whole(r, h) for r, h in rows]


@pytest.mark.parametrize("near", [0, 256])
def test_edits_of_long_rows(monkeypatch, near):
    monkeypatch.setattr(A, "_NEAR", near)
    rows = list(pairs(7, 300, 60))
    ops = A.align_ops(*(lists(x) for x in zip(*rows, strict=True))).to_pylist()
    assert [[(o["op"], o["ref"], o["hyp"]) for o in x] for x in ops] == [plain(r, h) for r, h in rows]
    counts = A.count_edits(*(lists(x) for x in zip(*rows, strict=True))).to_pylist()
    assert [c["sub"] + c["ins"] + c["del"] for c in counts] == [whole(r, h) for r, h in rows]


def test_a_batch_goes_in_slices(monkeypatch):
    """However much a batch holds, arrays are made of so many items at a time."""
    held, made = [], A._Slots.__init__
    monkeypatch.setattr(A, "_ITEMS", 2000)
    monkeypatch.setattr(A._Slots, "__init__", lambda self, a, b, kinds: (held.append(len(a[0]) + len(b[0])), made(self, a, b, kinds))[1])
    rows = list(pairs(9, 200, 60))
    got = A.count_chars(*(pa.array(["".join(x) for x in side]) for side in zip(*rows, strict=True))).to_pylist()
    counts = A.count_edits(*(lists(x) for x in zip(*rows, strict=True))).to_pylist()
    assert got == [c["sub"] + c["ins"] + c["del"] for c in counts] == [whole(r, h) for r, h in rows]
    assert len(held) > 10 and max(held) <= 2000 + max(len(r) + len(h) for r, h in rows)


def test_long_rows_go_together(monkeypatch):
    """Twenty texts of 1,500 letters: none is aligned by itself."""
    rng = random.Random(3)
    refs = [[rng.choice("abcdefgh") for _ in range(1500)] for _ in range(20)]
    hyps = [[x for x in r if rng.random() > 0.05] for r in refs]
    want = [whole(r, h) for r, h in zip(refs, hyps, strict=True)]
    alone = []
    monkeypatch.setattr(A, "_columns", lambda *a, **k: alone.append(a))
    assert A.count_chars(pa.array(["".join(x) for x in refs]), pa.array(["".join(x) for x in hyps])).to_pylist() == want and not alone
