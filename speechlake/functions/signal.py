"""How far speech stands above noise: energies of short frames, a noise floor by a streaming quantile, speech by hysteresis.

A recording is seen in blocks. Frames of FRAME_MS have an energy, the mean square of their samples (full scale is 1). A
histogram of energies in steps of STEP_DB, which adds up over blocks, gives the floor: the level that FLOOR_SHARE of
the frames with any energy don't exceed. Speech begins with a frame ON_DB above the floor and goes on until one is less than
OFF_DB above it. The ratio is that of the speech frames' mean energy, less the noise's, to the mean energy of all other
frames.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np

FRAME_MS, STEP_DB, FLOOR_SHARE, ON_DB, OFF_DB = 10, 0.5, 0.1, 9.0, 4.0
#: Level below which a frame is silence, and that stands for noise of no energy.
SILENCE_DB = -110.0
BLOCK = 1 << 18


def samples_of(content: bytes) -> tuple[int, Iterator[np.ndarray]]:
    """(rate, blocks of mono samples between -1 and 1) of a PCM WAV file."""
    w = wave.open(io.BytesIO(content))
    width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
    frame = max(1, rate * FRAME_MS // 1000)

    def blocks() -> Iterator[np.ndarray]:
        with w:
            w.rewind()
            step = max(1, BLOCK // frame) * frame  # whole frames, so that blocks don't cut any
            while raw := w.readframes(step):
                if width == 1:
                    x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
                elif width == 3:
                    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                    x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
                else:
                    x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
                yield x.reshape(-1, channels).mean(1)

    return rate, blocks()


def energies(x: np.ndarray, frame: int) -> np.ndarray:
    """Mean squares of the frames, the last of which may be shorter."""
    starts = np.arange(0, len(x), frame)
    return np.add.reduceat(x * x, starts) / np.diff(np.r_[starts, len(x)]) if len(x) else np.zeros(0)


def levels(e: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(e, 1e-30))


class Floor:
    """A histogram of levels; any number of them can be added up."""

    def __init__(self):
        self.counts = np.zeros(int(-SILENCE_DB / STEP_DB) + 2, np.int64)

    def add(self, e: np.ndarray) -> None:
        db = levels(e)
        at = np.ceil((db[db > SILENCE_DB] - SILENCE_DB) / STEP_DB).astype(np.int64)
        self.counts += np.bincount(np.minimum(at, len(self.counts) - 1), minlength=len(self.counts))

    def level(self) -> float | None:
        """The upper end of the step in which the share is reached; None where all is silence."""
        n = int(self.counts.sum())
        if not n:
            return None
        return SILENCE_DB + STEP_DB * int(np.searchsorted(np.cumsum(self.counts), math.ceil(FLOOR_SHARE * n)))


def speech(db: np.ndarray, floor: float, inside: bool = False) -> tuple[np.ndarray, bool]:
    """(which frames are speech, whether the last one is), going on from ``inside``."""
    turn = np.where(db >= floor + ON_DB, 1, np.where(db < floor + OFF_DB, 0, -1))
    last = np.maximum.accumulate(np.where(turn >= 0, np.arange(len(db)), -1))
    out = np.where(last >= 0, turn[last], int(inside)).astype(bool)
    return out, bool(out[-1]) if len(out) else inside


def measure(content: bytes | None) -> tuple[float | None, float | None, float | None, float | None]:
    """(seconds, mean level in dB, seconds of speech, signal-to-noise ratio in dB) of a WAV file. What isn't there is None: all where it can't be read, the ratio where no frame is speech or all are."""
    if not content:
        return None, None, None, None
    try:
        rate, blocks = samples_of(content)
        frame = max(1, rate * FRAME_MS // 1000)
        parts, n, floor = [], 0, Floor()
        for x in blocks:
            e = energies(x, frame)
            floor.add(e)
            parts.append(e)  # a number for each hundredth of a second
            n += len(x)
    except (wave.Error, EOFError, ValueError, ZeroDivisionError):
        return None, None, None, None
    if not n:
        return 0.0, None, 0.0, None
    e, level = np.concatenate(parts), floor.level()
    mean = float(levels(np.array([e.mean()]))[0])
    if level is None:
        return n / rate, None, 0.0, None
    talks, _ = speech(levels(e), level)
    seconds = min(n / rate, float(talks.sum()) * frame / rate)
    if not talks.any() or talks.all():
        return n / rate, mean, seconds, None
    noise = max(float(e[~talks].mean()), 10 ** (SILENCE_DB / 10))
    return n / rate, mean, seconds, 10 * math.log10(max(float(e[talks].mean()) - noise, 1e-30) / noise)
