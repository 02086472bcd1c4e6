"""Pictures from pixel values: 8- or 16-bit PNG without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode_png(values: np.ndarray) -> bytes:
    """Unsigned 8- or 16-bit arrays of shape (rows, columns) or (rows, columns, 3)."""
    v = np.asarray(values)
    if v.dtype not in (np.uint8, np.uint16) or v.ndim not in (2, 3):
        raise TypeError("8- or 16-bit grey or RGB values are needed")
    depth = v.dtype.itemsize * 8
    lines = v.astype(v.dtype.newbyteorder(">")).reshape(v.shape[0], -1)
    raw = b"".join(b"\0" + line.tobytes() for line in lines)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", v.shape[1], v.shape[0], depth, 2 if v.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_levels(values: np.ndarray, bitpix: int) -> np.ndarray:
    """Values of an image as picture levels: 8-bit as they are, 16-bit clamped, floats from [0, 1] to 0..255."""
    v = np.nan_to_num(np.asarray(values, np.float64))
    if bitpix == 8:
        return np.clip(v, 0, 255).astype(np.uint8)
    if bitpix == 16:
        return np.clip(v, 0, 65535).astype(np.uint16)
    if bitpix < 0:
        return np.floor(np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8)
    raise TypeError(f"no picture from BITPIX {bitpix}")
