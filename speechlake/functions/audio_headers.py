"""How long an audio file is, from its headers: RIFF chunks, FLAC stream information, MP3 frames and their rate tags.

A file is seen as byte ranges, of which only headers are read: chunk by chunk in RIFF, one block in FLAC, and of MP3 the
first frame, the tag of a variable rate where it has one, and CHECKED frames more. An MP3 file without a tag whose rate
changes within these is walked frame by frame, in pieces of PIECE bytes, and is the one case that reads a file whole.
Lengths are the decoder's input: samples that an encoder has put before or behind are counted.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

#: Frames that must agree before a constant rate is believed; bytes in which the first frame must begin; bytes read at once on a walk.
CHECKED, SEARCH, PIECE = 8, 1 << 16, 1 << 16
#: Bit rates in kbit/s by (MPEG 1, layer), and sample rates of MPEG 1; half in MPEG 2, a quarter in 2.5.
_RATES = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_SAMPLES = [44100, 48000, 32000]


class Ranges:
    """A file as byte ranges; ``seen`` counts the bytes read."""

    def __init__(self, read: Callable[[int, int], bytes], length: int):
        self._read, self.length, self.seen = read, length, 0

    def __call__(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.length - at))
        got = self._read(at, n) if n else b""
        self.seen += len(got)
        return got


def of_bytes(content: bytes) -> Ranges:
    return Ranges(lambda at, n: content[at : at + n], len(content))


def seconds(file: Ranges) -> float | None:
    """The length of a WAV, FLAC or MP3 file; None where its headers don't tell."""
    try:
        start = 0
        head = file(0, 12)
        if head[:3] == b"ID3" and len(head) >= 10:
            start = 10 + sum((b & 127) << 7 * k for k, b in enumerate(head[9:5:-1])) + (10 if head[5] & 16 else 0)
            head = file(start, 12)
        if head[:4] in (b"RIFF", b"RF64") and head[8:12] == b"WAVE":
            return _riff(file, start, head[:4] == b"RF64")
        if head[:4] == b"fLaC":
            return _flac(file, start)
        return _mpeg(file, start)
    except (struct.error, IndexError, ZeroDivisionError):
        return None


def _riff(file: Ranges, start: int, wide: bool) -> float | None:
    at, form, fact, data64 = start + 12, None, None, None
    while at + 8 <= file.length:
        name, size = struct.unpack("<4sI", file(at, 8))
        if name == b"ds64" and wide:
            data64 = struct.unpack("<Q", file(at + 16, 8))[0]
        elif name == b"fmt ":
            form = struct.unpack("<HHIIHH", file(at + 8, 16))
        elif name == b"fact" and size >= 4:
            fact = struct.unpack("<I", file(at + 8, 4))[0]
        elif name == b"data":
            if form is None:
                return None
            kind, _, rate, per_second, block, _ = form
            left = file.length - at - 8
            size = data64 if wide and size == 0xFFFFFFFF and data64 is not None else size
            size = left if size in (0, 0xFFFFFFFF) or size > left else size  # written as a stream, or cut off
            if kind in (1, 3, 0xFFFE):
                return size // block / rate
            return fact / rate if fact else size / per_second
        at += 8 + size + (size & 1)
    return None


def _flac(file: Ranges, start: int) -> float | None:
    info = file(start + 4, 38)
    if info[0] & 127:
        return None
    packed = int.from_bytes(info[4 + 10 : 4 + 18], "big")
    rate, samples = packed >> 44, packed & ((1 << 36) - 1)
    return samples / rate if samples and rate else None


def frame(head: bytes) -> tuple[int, int, int, int] | None:
    """(bytes, samples, sample rate, bit rate) of the frame that begins with these four bytes."""
    if len(head) < 4 or head[0] != 255 or head[1] & 224 != 224:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    rate, sample = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or sample == 3:
        return None
    one = version == 3
    bits = _RATES[one, layer][rate - 1] * 1000
    hertz = _SAMPLES[sample] // {3: 1, 2: 2, 0: 4}[version]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    pad = head[2] >> 1 & 1
    size = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    return size, samples, hertz, bits


def _mpeg(file: Ranges, start: int) -> float | None:
    near = file(start, SEARCH)
    for k in range(len(near) - 3):
        if near[k] == 255 and (first := frame(near[k : k + 4])):
            after = frame(file(start + k + first[0], 4))
            if start + k + first[0] >= file.length - 3 or after and after[2] == first[2]:
                break
    else:
        return None
    at = start + k
    size, samples, hertz, bits = first
    tag = near[k : k + 192]
    one, mono = near[k + 1] >> 3 & 3 == 3, near[k + 3] >> 6 == 3
    side = 4 + ((17 if mono else 32) if one else (9 if mono else 17))
    if tag[side : side + 4] in (b"Xing", b"Info") and tag[side + 7] & 1:
        return int.from_bytes(tag[side + 8 : side + 12], "big") * samples / hertz
    if tag[36:40] == b"VBRI":
        return int.from_bytes(tag[36 + 14 : 36 + 18], "big") * samples / hertz
    end = file.length - (128 if file(file.length - 128, 3) == b"TAG" else 0)
    rates, p = set(), at
    for _ in range(CHECKED):
        one_frame = frame(file(p, 4))
        if p >= end or not one_frame:
            break
        rates.add(one_frame[3])
        p += one_frame[0]
    if len(rates) == 1:
        return (end - at) * 8 / bits
    count, p, piece, begin = 0, at, b"", 0
    while p + 4 <= end:
        if not begin <= p <= begin + len(piece) - 4:
            piece, begin = file(p, PIECE), p
        one_frame = frame(piece[p - begin : p - begin + 4])
        if not one_frame:
            break
        count, p = count + one_frame[1], p + one_frame[0]
    return count / hertz if count else None
