"""Windows of crowded anchors are told apart by two hashes, each of which alone tells these."""

import numpy as np

from speechlake.llm import exact_substring as m


def test_each_hash_tells_windows_apart():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 256, 300).astype(np.uint8)
    altered = [base]
    for k in range(300):  # one byte differs, anywhere in a window
        one = base.copy()
        one[k] ^= 1 << (k % 8)
        altered.append(one)
    data = np.concatenate(altered)
    p = np.concatenate([np.arange(0, 201, 25) + 300 * k for k in range(301)])
    windows = [data[a : a + m.WIDTH].tobytes() for a in p]
    for h in m.window_hashes(data, p):
        names = {}
        for w, x in zip(windows, h.tolist(), strict=True):
            assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)


def test_hashes_do_not_depend_on_the_place():
    text = np.frombuffer(b"a repeated passage, " * 12, np.uint8)
    a = m.window_hashes(text, np.array([0, 20, 40, 1]))
    for h in a:
        assert h[0] == h[1] == h[2] != h[3]
    assert all(len(h) == 0 for h in m.window_hashes(text[:10], np.zeros(0, np.int64)))
