"""Signal-to-noise ratios of signals made by hand; blocks, widths, channels; hysteresis; odd files."""

import io
import math
import wave

import numpy as np
import pytest

from speechlake.functions import signal as S


def wav(x, rate=16_000, width=2, channels=1):
    x, out = np.repeat(np.clip(x, -1, 1)[:, None], channels, 1).ravel(), io.BytesIO()
    full = float((1 << (8 * width - 1)) - 1)
    if width == 1:
        raw = np.round(x * 127 + 128).astype(np.uint8).tobytes()
    elif width == 3:
        raw = np.round(x * full).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        raw = np.round(x * full).astype(f"<i{width}").tobytes()
    with wave.open(out, "wb") as w:
        w.setparams((channels, width, rate, 0, "NONE", ""))
        w.writeframes(raw)
    return out.getvalue()


def talk(snr, seconds=20, rate=16_000, noise=0.01, seed=1):
    """White noise with a tone of known power in every other second."""
    t = np.arange(seconds * rate) / rate
    on = (t.astype(int) % 2) == 1
    tone = noise * math.sqrt(2 * 10 ** (snr / 10)) * np.sin(2 * np.pi * 300 * t)
    return np.random.default_rng(seed).normal(0, noise, len(t)) + np.where(on, tone, 0)


@pytest.mark.parametrize("snr", [12, 15, 20, 30])
def test_known_ratios(snr):
    seconds, _, speech, found = S.measure(wav(talk(snr)))
    assert seconds == 20 and abs(found - snr) < 0.6 and abs(speech - 10) < 0.3


@pytest.mark.parametrize("width,channels", [(2, 1), (2, 2), (3, 1), (4, 2)])
def test_widths_and_channels(width, channels):
    assert abs(S.measure(wav(talk(20), width=width, channels=channels))[3] - 20) < 0.6


def test_blocks_change_nothing(monkeypatch):
    raw = wav(talk(18))
    want = S.measure(raw)
    for block in (1000, 7777, 1 << 20):
        monkeypatch.setattr(S, "BLOCK", block)
        assert S.measure(raw) == want


def test_hysteresis():
    db = np.array([0, 5, 9, 5, 4, 3.9, 5, 8.9, 20, 4, 0])
    assert S.speech(db, 0.0)[0].tolist() == [False, False, True, True, True, False, False, False, True, True, False]
    first, state = S.speech(db[:4], 0.0)
    rest, _ = S.speech(db[4:], 0.0, state)
    assert np.r_[first, rest].tolist() == S.speech(db, 0.0)[0].tolist()


def test_floors_add_up():
    e = np.random.default_rng(2).uniform(1e-6, 1e-2, 1000)
    whole, a, b = S.Floor(), S.Floor(), S.Floor()
    whole.add(e)
    a.add(e[:300])
    b.add(e[300:])
    a.counts += b.counts
    assert a.level() == whole.level()
    assert abs(whole.level() - np.quantile(10 * np.log10(e), 0.1)) <= 2 * S.STEP_DB


def test_what_has_no_ratio():
    assert S.measure(None) == S.measure(b"") == S.measure(b"RIFF no file") == (None,) * 4
    assert S.measure(wav(np.zeros(0))) == (0.0, None, 0.0, None)
    assert S.measure(wav(np.zeros(16_000))) == (1.0, None, 0.0, None)
    noise = S.measure(wav(np.random.default_rng(3).normal(0, 0.01, 160_000)))
    assert noise[2] < 0.5 and noise[3] is None or noise[3] < 12
    clean = np.zeros(32_000)
    clean[16_000:] = 0.5
    assert S.measure(wav(clean))[3] is None or S.measure(wav(clean))[3] > 60


def test_rows(spark):
    from speechlake.operators import inference

    rows = [("loud", bytearray(wav(talk(20)))), ("poor", bytearray(wav(np.random.default_rng(3).normal(0, 0.01, 16_000)))), ("none", None), ("bad", bytearray(b"x"))]
    found = inference.with_signal(spark.createDataFrame(rows, "name string, content binary"))
    assert found.count() == 4 and [r.name for r in inference.signal_filter(found, 12.0).collect()] == ["loud"]
