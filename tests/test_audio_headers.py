"""Lengths from headers: files made by hand, bytes read, damaged files."""

import io
import struct
import wave

import pytest

from speechlake.functions import audio_headers as A


def wav(n, rate=8000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((channels, width, rate, 0, "NONE", ""))
        w.writeframes(bytes(n * width * channels))
    return out.getvalue()


def flac(n, rate=16000, body=5000):
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + ((rate << 44) | (15 << 36) | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([128, 0, 0, 34]) + info + bytes(body)


def head(rate=9, sample=0, version=3, layer=3, pad=0, mono=False):
    return bytes([255, 224 | version << 3 | (4 - layer) << 1 | 1, rate << 4 | sample << 2 | pad << 1, 192 if mono else 0])


def mp3(rates, **more):
    return b"".join(head(r, **more) + bytes(A.frame(head(r, **more))[0] - 4) for r in rates)


def id3(n):
    return b"ID3\x04\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + b"\xff" * n


def test_wav():
    assert A.seconds(A.of_bytes(wav(12_000))) == 1.5
    raw = wav(12_000, channels=2, width=4)
    odd = raw[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + raw[12:]
    file = A.of_bytes(odd)
    assert A.seconds(file) == 1.5 and file.seen < 100
    at = raw.index(b"data")
    for size in (0, 0xFFFFFFFF, 1 << 30):  # a stream, or cut off
        assert A.seconds(A.of_bytes(raw[: at + 4] + struct.pack("<I", size) + raw[at + 8 :])) == 1.5
    wide = b"RF64" + raw[4:12] + b"ds64" + struct.pack("<IQQQI", 28, 0, 12_000 * 8, 12_000, 0) + raw[12 : at + 4] + b"\xff" * 4 + raw[at + 8 :] + b"junk behind"
    assert A.seconds(A.of_bytes(wide)) == 1.5
    assert A.seconds(A.of_bytes(raw[:12])) is None


def test_flac():
    file = A.of_bytes(flac(40_000))
    assert A.seconds(file) == 2.5 and file.seen < 64
    assert A.seconds(A.of_bytes(id3(300) + flac(48_000, 48_000))) == 1.0
    assert A.seconds(A.of_bytes(flac((1 << 36) - 1, 655_350))) == ((1 << 36) - 1) / 655_350
    assert A.seconds(A.of_bytes(flac(0))) is None


@pytest.mark.parametrize("more", [{}, {"version": 2}, {"version": 0, "sample": 1}, {"layer": 2}, {"layer": 1}, {"mono": True, "sample": 2}])
def test_constant_rate(more):
    raw = mp3([9] * 400, **more)
    size, samples, hertz, bits = A.frame(head(9, **more))
    file = A.of_bytes(id3(5000) + raw + b"TAG" + bytes(125))
    assert A.seconds(file) == len(raw) * 8 / bits and abs(len(raw) * 8 / bits - 400 * samples / hertz) < 0.02 * 400 * samples / hertz
    assert file.seen <= A.SEARCH + 300


def test_rate_tags():
    for name, at in ((b"Xing", 36), (b"Info", 36)):
        first = bytearray(mp3([9]))
        first[at : at + 12] = name + struct.pack(">II", 1, 777)
        file = A.of_bytes(bytes(first) + mp3([5, 9, 12] * 50))
        assert A.seconds(file) == 777 * 1152 / 44100 and file.seen <= A.SEARCH + 300
    first = bytearray(mp3([9]))
    first[36:54] = b"VBRI" + bytes(10) + struct.pack(">I", 55)
    assert A.seconds(A.of_bytes(bytes(first) + mp3([9]))) == 55 * 1152 / 44100


def test_a_changing_rate_without_a_tag_is_walked():
    rates = [1, 5, 9, 14] * 300
    assert A.seconds(A.of_bytes(mp3(rates))) == 1200 * 1152 / 44100


def test_what_is_no_audio():
    for raw in (b"", b"x", b"ID3", bytes(1000), b"\xff" * 1000, b"hello " * 100, b"RIFF1234WAVE", b"fLaC", id3(10), wav(10)[:30]):
        assert A.seconds(A.of_bytes(raw)) is None


def test_durations_by_rows(spark, tmp_path):
    from speechlake.operators import inference

    made = {"a.wav": wav(8000), "b.flac": flac(16_000), "c.mp3": mp3([9] * 100), "d.mp3": b"none"}
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    want = {"a.wav": 1.0, "b.flac": 1.0, "c.mp3": 100 * 417 * 8 / 128_000, "d.mp3": None, "gone.wav": None}
    named = spark.createDataFrame([(str(tmp_path / n),) for n in want], "path string")
    got = {r.audio_filepath.rsplit("/", 1)[1]: (r.duration, r.bytes_read) for r in inference.named_durations(named).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    files = spark.createDataFrame([(n, bytearray(raw)) for n, raw in made.items()], "audio_filepath string, content binary")
    assert {r.audio_filepath: r.duration for r in inference.with_durations(files).collect()} == {k: v for k, v in want.items() if k != "gone.wav"}
