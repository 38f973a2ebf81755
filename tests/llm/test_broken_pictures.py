"""Pictures that are cut, changed or made up: each is decoded or named as broken, in bounded time and memory."""

import time

import numpy as np
import pytest

from chirplake.llm import pjpeg
from test_llm_operators import arbitrary_jpeg


def outcome(data):
    try:
        return pjpeg.to_rgb(pjpeg.Decoder(data, pjpeg.MAX_PIXELS).decode()).shape
    except pjpeg.BROKEN as e:
        return type(e).__name__


def test_changed_bytes():
    """Any other exception than those of BROKEN fails the test."""
    rng = np.random.default_rng(21)
    seen = set()
    began = time.time()
    for k in range(700):
        data = bytearray(arbitrary_jpeg(rng, int(rng.integers(1, 40)), int(rng.integers(1, 40)), grey=k % 3 == 0)[0] if k % 2 else pjpeg.store_payload(bytes(rng.integers(0, 256, 64 * int(rng.integers(1, 9)), dtype=np.uint8))))
        for _ in range(int(rng.integers(1, 6))):
            data[int(rng.integers(0, len(data)))] = int(rng.integers(0, 256))
        if k % 5 == 0:
            data = data[: int(rng.integers(0, len(data)))]
        got = outcome(bytes(data))
        seen.add(got if isinstance(got, str) else "decoded")
    assert {"decoded", "ValueError"} <= seen and time.time() - began < 120


def test_every_header_byte():
    data, _ = arbitrary_jpeg(np.random.default_rng(3), 20, 20)
    head = data[: data.index(b"\xff\xda") + 12]
    for at in range(2, len(head)):
        if data[at - 2 : at] in (b"\xff\xc4",) or (at > 200 and at % 7):
            continue
        for value in (0, 1, 127, 255):
            outcome(data[:at] + bytes([value]) + data[at + 1 :])


def frame(width, height, parts=((1, 0x11, 0),)):
    return pjpeg._segment(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(map(bytes, parts)))


@pytest.mark.parametrize(
    "data",
    [
        b"", b"\xff\xd8", b"\xff\xd8\xff", b"\xff\xd8" + frame(65535, 65535), b"\xff\xd8" + frame(0, 10), b"\xff\xd8" + frame(8, 8, ((1, 0x00, 0),)), b"\xff\xd8" + frame(8, 8) + frame(8, 8),
        b"\xff\xd8\xff\xda\x00\x08\x01\x01\x00\x00\x00\x00", b"\xff\xd8\xff\xfe\x00\x00", b"\xff\xd8\xff\xc4\x00\x00" * 9, b"\xff\xd8" + frame(8, 8) + b"\xff\xda\x00\x08\x01\x01\x00\x05\x01\x00" + b"\x12" * 9,
        b"\xff\xd8" + frame(4000, 4000) + pjpeg._segment(0xC4, b"\x10" + bytes([1]) + bytes(15) + b"\xe0") + (pjpeg._scan_header((1,), 0, 1, 63, 0, 0) + b"\0") * 2000,
    ],
)
def test_made_up(data):
    began = time.time()
    assert outcome(data) in ("ValueError", "IndexError", "KeyError")
    assert time.time() - began < 60


def test_odd_sampling():
    """Chroma at two thirds of the luma: each pixel takes the sample over it."""
    parts = [pjpeg.Component(k, h, h, 0, 0, 0, np.zeros((h, h, 64), np.int32)) for k, h in ((1, 3), (2, 2), (3, 2))]
    assert pjpeg.to_rgb(pjpeg.Frame(24, 24, parts, {0: np.ones(64, np.int32)}, [])).shape == (24, 24, 3)


def test_a_broken_column_fails_no_task(spark):
    good = pjpeg.store_payload(b"x" * 64)
    media = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:80])), (3, bytearray(b"\xff\xd8" + frame(8, 8, ((1, 0x00, 0),)))), (3, bytearray(b"\xff\xd8\xff\xda\x00\x08\x01\x01\x00\x00\x00\x00")), (None, None), (4, bytearray(b"\xff\xd8" + frame(65535, 65535)))], "data int, rgb binary")
    got = pjpeg.decode_column(media, "data", "rgb").collect()
    assert len(got) == 6 and sum(r["error"] is None for r in got) == 1
    assert pjpeg.decode_column(media.limit(0), "data", "rgb").count() == 0
