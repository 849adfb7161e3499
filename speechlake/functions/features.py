"""Audio at another rate, and log mel features of it.

Resampling is a windowed sinc at the lower of both rates' band limits, ZEROS crossings to either side under a Kaiser
window, in polyphase form: with rates in lowest terms L : M only L sets of weights exist, one for each place that an output
sample can have between two input samples. Outputs are made block by block, each from the inputs that its weights reach, so
that blocks of any size join without a seam. Up to PASS of the lower band limit a tone keeps its level within 0.1 %, and
what lies above 1 / PASS of it falls by 80 dB.

Features are those that the recognizer's front end takes: frames of 25 ms each 10 ms, reflected at the ends, under a
periodic Hann window; power in MELS triangles of equal area on a mel scale that is linear up to 1 kHz and logarithmic beyond;
tenfold logarithms no further than 8 below the clip's highest, scaled.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

RATE, MELS, WINDOW, HOP = 16_000, 80, 400, 160
ZEROS, BETA, PASS = 48, 9.0, 0.85
#: Output samples, or frames, that are made at once.
BLOCK = 1 << 13


@lru_cache(maxsize=16)
def weights(up: int, down: int) -> tuple[np.ndarray, int]:
    """(a row of weights for each phase, how many inputs lie before the first whose place is not after the output's)."""
    cut = min(1.0, up / down) * (1 + PASS) / 2
    half = math.ceil(ZEROS / min(1.0, up / down))
    k = np.arange(-half + 1, half + 1)
    t = k[None, :] - np.arange(up)[:, None] / up  # inputs between an input sample and the output
    w = cut * np.sinc(cut * t) * np.i0(BETA * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(BETA)
    return w / w.sum(1, keepdims=True), half - 1


def resample(x: np.ndarray, rate: int, to: int = RATE, block: int = BLOCK) -> np.ndarray:
    """x at another rate: ceil(len(x) * to / rate) samples, silence taken for what lies outside."""
    x = np.asarray(x, np.float64)
    common = math.gcd(rate, to)
    up, down = to // common, rate // common
    if up == down or not len(x):
        return x
    w, before = weights(up, down)
    n, taps = -(-len(x) * up // down), w.shape[1]
    out = np.empty(n)
    for a in range(0, n, block):
        at = np.arange(a, min(n, a + block), dtype=np.int64) * down
        first, phase = at // up - before, at % up
        low, high = int(first[0]), int(first[-1]) + taps
        part = x[max(0, low) : max(0, min(len(x), high))]
        part = np.concatenate([np.zeros(max(0, -low)), part, np.zeros(max(0, high - max(len(x), max(0, low))))])
        windows = np.lib.stride_tricks.sliding_window_view(part, taps)
        out[a : a + len(at)] = np.einsum("ij,ij->i", windows[first - low], w[phase])
    return out


def mel(hertz):
    hertz = np.asarray(hertz, np.float64)
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + 27 * np.log(np.maximum(hertz, 1000) / 1000) / np.log(6.4))


def hertz(m):
    m = np.asarray(m, np.float64)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp(np.log(6.4) * (m - 15) / 27))


@lru_cache(maxsize=4)
def triangles(mels: int = MELS, rate: int = RATE, window: int = WINDOW) -> np.ndarray:
    """Weights of the spectrum's lines in each mel band."""
    lines = np.arange(window // 2 + 1) * rate / window
    edges = hertz(np.linspace(0, mel(rate / 2), mels + 2))
    rise = (lines[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - lines[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """(MELS, frames) features of samples at RATE, a frame for each HOP whole samples."""
    x, frames = np.asarray(x, np.float64), len(x) // HOP
    if not frames:
        return np.zeros((MELS, 0), np.float32)
    half = WINDOW // 2
    padded = np.pad(x, half, "reflect") if len(x) > half else np.pad(x, half)
    hann, bands = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW), triangles()
    out = np.empty((MELS, frames))
    every = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    for a in range(0, frames, block):
        power = np.abs(np.fft.rfft(every[a : min(frames, a + block)] * hann, axis=1)) ** 2
        out[:, a : a + block] = bands @ power.T
    out = np.log10(np.maximum(out, 1e-10))
    return ((np.maximum(out, out.max() - 8) + 4) / 4).astype(np.float32)


def clip_features(x: np.ndarray, rate: int, seconds: float | None = 30.0) -> np.ndarray:
    """Features of a clip of any rate, cut or filled with silence to a length; None: as long as it is."""
    y = resample(x, rate)
    if seconds is not None:
        n = round(seconds * RATE)
        y = np.concatenate([y[:n], np.zeros(max(0, n - len(y)))])
    return log_mel(y)
