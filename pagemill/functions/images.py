"""PNG files as gray arrays and back, without an image library: 8-bit gray, gray + alpha, RGB, RGBA and palettes, not
interlaced. Transparent pixels are laid on white."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _rows(raw: np.ndarray, height: int, stride: int, size: int) -> np.ndarray:
    """Undo the row filters."""
    out = np.zeros((height + 1, stride + size), np.uint8)
    lines = raw.reshape(height, stride + 1)
    for y in range(height):
        kind, line, above = lines[y, 0], lines[y, 1:].astype(np.int64), out[y].astype(np.int64)
        row = np.zeros(stride + size, np.int64)
        if kind in (0, 2):
            row[size:] = line + (above[size:] if kind == 2 else 0)
        elif kind == 1:  # a running sum over each byte of a pixel
            row[size:] = np.cumsum(line.reshape(-1, size), axis=0).reshape(-1)
        else:
            for i in range(size, stride + size):
                a, b, c = row[i - size] & 255, above[i], above[i - size]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i] = line[i - size] + guess
        out[y + 1] = row & 255
    return out[1:, size:]


def decode_png(data: bytes) -> np.ndarray:
    """Gray array of a PNG file; ValueError for anything else."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS:
        raise ValueError("unsupported PNG file")
    width, height, _, colour = head[:4]
    size = _CHANNELS[colour]
    img = _rows(np.frombuffer(zlib.decompress(body), np.uint8), height, width * size, size).reshape(height, width, size)
    if colour == 3:
        img = palette[img[:, :, 0]]
    img = img.astype(float)
    if colour in (4, 6):
        alpha = img[:, :, -1:] / 255
        img = img[:, :, :-1] * alpha + 255 * (1 - alpha)
    gray = img @ np.array([0.299, 0.587, 0.114]) if img.shape[2] == 3 else img[:, :, 0]
    return np.clip(np.rint(gray), 0, 255).astype(np.uint8)


def encode_png(img: np.ndarray) -> bytes:
    """A gray array as a PNG file."""
    height, width = img.shape
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    raw = np.zeros((height, width + 1), np.uint8)
    raw[:, 1:] = img
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")
