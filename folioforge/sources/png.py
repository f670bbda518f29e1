"""PNG images as tables of grey pixels, with the standard library and numpy alone.

Eight-bit images without interlacing are read: grey, colour, palette, each with or without alpha."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Scan lines with the filter of each undone; ``step`` bytes make a pixel."""
    out = np.zeros((height + 1, stride + step), np.int32)
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1).astype(np.int32)
    for k, line in enumerate(lines):
        kind, row, up = line[0], out[k + 1], out[k]
        row[step:] = line[1:]
        if kind == 1:
            row[step:] = (row[step:].reshape(-1, step).cumsum(0) & 255).reshape(-1)
        elif kind == 2:
            row[step:] = (row[step:] + up[step:]) & 255
        elif kind in (3, 4):
            for i in range(step, stride + step):
                a, b, c = int(row[i - step]), int(up[i]), int(up[i - step])
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i] = (int(row[i]) + ((a + b) // 2 if kind == 3 else near)) & 255
    return out[1:, step:].astype(np.uint8)


def grey(data: bytes) -> np.ndarray | None:
    """Grey levels (rows, columns), what is transparent on white; None for what isn't such an image."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    header, palette, alphas, body = None, None, b"", b""
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alphas = part
        elif kind == b"IDAT":
            body += part
    if header is None or header[2] != 8 or header[6] or header[3] not in CHANNELS:
        return None
    width, height, colour = header[0], header[1], header[3]
    n = CHANNELS[colour]
    try:
        px = _unfiltered(zlib.decompress(body), height, width * n, n).reshape(height, width, n).astype(np.int64)
    except (zlib.error, ValueError):
        return None
    alpha = px[..., -1] if colour in (4, 6) else np.full((height, width), 255)
    if colour == 3:
        table = np.append(np.frombuffer(alphas, np.uint8), np.full(256 - len(alphas), 255, np.uint8))
        alpha, px = table[px[..., 0]].astype(np.int64), palette[px[..., 0]].astype(np.int64)
    level = px[..., 0] if colour in (0, 4) else (px[..., 0] * 19595 + px[..., 1] * 38470 + px[..., 2] * 7471 + 0x8000) >> 16
    return ((level * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def pixels(files: DataFrame, stride: int = 1) -> DataFrame:
    """image, x, y, level of the PNG files (file_id, content), every ``stride``-th pixel both ways; what
    can't be read gives no rows. An image is given out row by row, so a batch is small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, data in zip(b["file_id"], b["content"], strict=True):
                levels = grey(bytes(data)) if data is not None else None
                if levels is None:
                    continue
                small = levels[::stride, ::stride]
                for y in range(0, len(small), 64):
                    block = small[y : y + 64]
                    ys, xs = np.divmod(np.arange(block.size), block.shape[1])
                    yield pd.DataFrame({"image": i, "x": xs.astype(np.int32), "y": (ys + y).astype(np.int32), "level": block.reshape(-1).astype(np.int32)})

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInPandas(run, f"image {kind}, x int, y int, level int")
