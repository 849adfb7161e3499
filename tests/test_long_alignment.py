"""The alignment takes texts of any length."""

import random

import pyarrow as pa
import pytest
from test_alignment import lists, plain

from speechlake.functions import alignment


def test_very_long_rows():
    ref = [str(k % 7) for k in range(40_000)]
    hyp = ["q", *ref[1:20_000], *ref[20_001:], "z"]
    for r, h, want in ((ref, [], (0, 0, 40_000)), ([], ref, (0, 40_000, 0)), (ref, hyp, (1, 1, 1))):
        (c,) = alignment.count_edits(lists([r]), lists([h])).to_pylist()
        assert (c["sub"], c["ins"], c["del"]) == want
    (ops,) = alignment.align_ops(lists([ref]), lists([hyp])).to_pylist()
    assert [k for k, o in enumerate(ops) if o["op"] != "correct"] == [0, 20_000, 40_000]


@pytest.mark.parametrize("bits", [1, 64, 1 << 28])
def test_columns_computed_again(monkeypatch, bits):
    monkeypatch.setattr(alignment, "_BITS", bits)
    rng = random.Random(bits)
    rows = [tuple([rng.choice("abc") for _ in range(rng.randrange(40))] for _ in "rh") for _ in range(200)]
    ops = alignment.align_ops(*(lists(x) for x in zip(*rows, strict=True))).to_pylist()
    assert [[(o["op"], o["ref"], o["hyp"]) for o in x] for x in ops] == [plain(r, h) for r, h in rows]
    chars = alignment.count_chars(*(pa.array(["".join(x) for x in side]) for side in zip(*rows, strict=True))).to_pylist()
    assert chars == [sum(o[0] != "correct" for o in plain(r, h)) for r, h in rows]


def test_long_texts_stay_near_the_line():
    """Far fewer bits than the whole table are worked on, and no edit differs from the whole table's."""
    import random

    from speechlake.functions import alignment as A

    rng = random.Random(2)
    for n, share in ((1500, 0.02), (1500, 0.3), (3000, 0.1)):
        ref = [rng.randrange(7) for _ in range(n)]
        hyp = [x for t in ref for x in ([] if rng.random() < share else [t] if rng.random() > share else [t, rng.randrange(7)])]
        bits, full = A._places(ref), (1 << n) - 1
        up, down = A._columns(bits, n, hyp, full, 0)
        found = A._bound(bits, n, hyp)
        assert found == A.distance(ref, hyp) == len(hyp) + up.bit_count() - down.bit_count() == len(A._edits(ref, hyp))
        wide, A.WIDE = A.WIDE, 10**9
        try:
            whole = A._edits(ref, hyp)
        finally:
            A.WIDE = wide
        assert A._edits(ref, hyp) == whole
        if share == 0.02:
            _, windows = A._band(bits, n, hyp, found, True)[1]
            assert max(u.bit_length() for _, kept in windows for _, u in kept) < n // 2
    assert A.distance([1, 2], []) == 2 and A.distance([], [1]) == 1
