"""A diagnostic scatter as a PNG, of a few cells."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Height and width of the picture, its margin, and half the side of a point.
SIZE, MARGIN, HALF = (320, 480), 30, 2


def scatter_png(x, y, diagonal: bool = True) -> bytes:
    """Points as dark squares in a frame with equal scales for both axes, and the line of equal values."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    fine = np.isfinite(x) & np.isfinite(y)
    x, y = x[fine], y[fine]
    every = np.concatenate([x, y]) if len(x) else np.array([0.0, 1.0])
    low, high = float(every.min()), float(every.max())
    width = high - low or 1.0
    height, length = SIZE
    canvas = np.full((height, length), 255, np.uint8)
    top, bottom, left, right = MARGIN, height - MARGIN, MARGIN, length - MARGIN
    canvas[[top, bottom], left : right + 1] = 120
    canvas[top : bottom + 1, [left, right]] = 120
    column = lambda v: np.round(left + (v - low) / width * (right - left)).astype(int)
    row = lambda v: np.round(bottom - (v - low) / width * (bottom - top)).astype(int)
    if diagonal:
        line = np.linspace(low, high, 2 * length)
        canvas[row(line), column(line)] = 180
    for r, c in zip(row(y), column(x), strict=True):
        canvas[r - HALF : r + HALF + 1, c - HALF : c + HALF + 1] = 20
    raw = np.concatenate([np.zeros((height, 1), np.uint8), canvas], axis=1).tobytes()  # no filter on any line
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", length, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 9)) + part(b"IEND", b"")
