"""Resampling within its stated error, blocks without seams; mel features against a plain transform."""

import math

import numpy as np
import pytest

from speechlake.functions import features as X

RATES = [8000, 11_025, 22_050, 44_100, 48_000, 16_001]


@pytest.mark.parametrize("rate", RATES)
def test_tones_keep_their_level(rate):
    limit = min(rate, X.RATE) / 2
    for share in (0.01, 0.1, 0.5, 0.8, X.PASS):
        f = share * limit
        n = rate // 2
        y = X.resample(np.sin(2 * np.pi * f * np.arange(n) / rate), rate)
        assert len(y) == -(-n * X.RATE // rate)
        t = np.arange(len(y)) / X.RATE
        inner = slice(len(y) // 4, 3 * len(y) // 4)
        assert np.abs(y - np.sin(2 * np.pi * f * t))[inner].max() < 1e-3, share


@pytest.mark.parametrize("rate", [22_050, 44_100, 48_000])
def test_what_lies_above_falls_away(rate):
    f = 8000 / X.PASS
    y = X.resample(np.sin(2 * np.pi * f * np.arange(rate) / rate), rate)
    assert 20 * math.log10(np.abs(y[2000:-2000]).max()) < -80


@pytest.mark.parametrize("rate", RATES)
def test_blocks_join(rate):
    x = np.random.default_rng(rate).standard_normal(5000)
    whole = X.resample(x, rate, block=1 << 20)
    for block in (1, 333, 4096):
        assert np.array_equal(X.resample(x[: 800 if block == 1 else 5000], rate, block=block), whole if block > 1 else X.resample(x[:800], rate, block=1 << 20))


def test_a_sweep():
    rate, seconds = 48_000, 2
    t = np.arange(rate * seconds) / rate
    phase = lambda t: 2 * np.pi * (50 * t + (6500 - 50) / (2 * seconds) * t * t)
    y = X.resample(np.sin(phase(t)), rate)
    want = np.sin(phase(np.arange(len(y)) / X.RATE))
    assert np.abs(y - want)[500:-500].max() < 2e-3


def test_same_rate_and_nothing():
    x = np.arange(5.0)
    assert np.array_equal(X.resample(x, 16_000), x) and len(X.resample(np.zeros(0), 8000)) == 0 and len(X.resample(np.ones(1), 8000)) == 2


def test_features_by_definition(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16_000 // 5)
    padded = np.concatenate([x[200:0:-1], x, x[-2:-202:-1]])
    n = np.arange(400)
    window = 0.5 * (1 - np.cos(2 * np.pi * n / 400))
    lines = np.exp(-2j * np.pi * np.outer(np.arange(201), n) / 400)
    bands = X.triangles()
    frames = [bands @ (np.abs(lines @ (padded[k * 160 : k * 160 + 400] * window)) ** 2) for k in range(len(x) // 160)]
    want = np.log10(np.maximum(np.array(frames).T, 1e-10))
    want = (np.maximum(want, want.max() - 8) + 4) / 4
    got = X.log_mel(x)
    assert got.shape == (80, 20) and np.abs(got - want).max() < 1e-5
    assert np.array_equal(X.log_mel(x, block=3), got)


def test_the_mel_scale():
    f = np.array([0, 200 / 3, 500, 1000, 6400])
    assert np.allclose(X.mel(f), [0, 1, 7.5, 15, 42]) and np.allclose(X.hertz(X.mel(f)), f)
    areas = X.triangles().sum(1) * 40  # each band's area over the lines' spacing
    assert np.all((areas > 0.5) & (areas < 1.5))


def test_a_tone_lies_in_its_band():
    x = np.sin(2 * np.pi * 1000 * np.arange(48_000) / 48_000)
    m = X.clip_features(x, 48_000, None)
    edges = X.hertz(np.linspace(0, X.mel(8000), 82))
    k = int(m[:, 50].argmax())
    assert edges[k] <= 1000 <= edges[k + 2]
    assert X.clip_features(x, 48_000).shape == (80, 3000)


def test_rows(spark):
    import test_signal

    from speechlake.operators import inference

    rows = [(1, bytearray(test_signal.wav(test_signal.talk(20, 2, 8000), 8000))), (2, None), (3, bytearray(b"x"))]
    got = {r.k: r for r in inference.with_features(spark.createDataFrame(rows, "k long, content binary"), seconds=1.0).collect()}
    assert len(got[1].features) == 80 and len(got[1].features[0]) == 100 and got[1].n_samples == 32_000 and got[2].features is None and got[3].n_samples is None


@pytest.mark.parametrize("i", [0, 1, 9, 18, 27])
def test_a_burst_of_a_recording_stands_in_its_features(i):
    """Within the burst, away from its ends, the highest band has risen by the ratio of the levels; a tone that resampling takes away would leave only ends."""
    from speechlake import file_queries
    from speechlake.functions import signal

    rate, blocks = signal.samples_of(file_queries._recording(i))
    top = X.clip_features(np.concatenate(list(blocks)), rate, None).max(0)
    assert np.abs(top[32:38] - top[5:26].max() - math.log10((2 + i % 9) ** 2) / 4).max() < 0.01
