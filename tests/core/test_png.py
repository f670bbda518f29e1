"""PNG images written here, with every filter and kind of colour."""

import struct
import zlib

import numpy as np
import pytest
from folioforge.operators import imaging
from folioforge.sources.png import grey, pixels


def png(rows, colour, filters, extra=b"", width=None):
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    height, width = len(rows), len(rows[0]) // n
    raw, before = b"", bytes(len(rows[0]))
    for row, f in zip(rows, filters, strict=True):
        line = bytearray()
        for i, v in enumerate(row):
            a = row[i - n] if i >= n else 0
            b, c = before[i], before[i - n] if i >= n else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, paeth)[f]) & 255)
        raw += bytes([f]) + bytes(line)
        before = row
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + extra + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_all_filters(colour):
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    values = np.random.default_rng(colour).integers(0, 256, (5, 7, n))
    data = png([bytes(r.reshape(-1).tolist()) for r in values], colour, [0, 1, 2, 3, 4])
    alpha = values[..., -1] if colour in (4, 6) else np.full((5, 7), 255)
    level = values[..., 0] if n < 3 else (values[..., 0] * 19595 + values[..., 1] * 38470 + values[..., 2] * 7471 + 0x8000) >> 16
    assert (grey(data) == (level * alpha + 255 * (255 - alpha) + 127) // 255).all()


def test_palettes_and_what_is_not_read():
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    data = png([bytes([0, 1])], 3, [0], part(b"PLTE", bytes([10, 10, 10, 200, 200, 200])) + part(b"tRNS", bytes([0])))
    assert grey(data).tolist() == [[255, 200]]
    assert grey(b"GIF") is None and grey(data[:-30]) is None


def test_tones_of_an_image(spark):
    rows = [bytes([30] * 4 + [220] * 12) for _ in range(6)]
    df = spark.createDataFrame([(1, png(rows, 0, [0] * 6)), (2, b"no"), (3, None)], "file_id long, content binary")
    px = pixels(df)
    assert px.count() == 96
    assert imaging.ink_paper(px, imaging.otsu(px)).first()[1:] == (30.0, 220.0) and imaging.noise(px).first()["noise"] == 0.0
