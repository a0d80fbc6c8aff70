"""Perceptual hashes of image bytes: greyscale, 32 x 32, the low frequencies of a cosine transform against their median.

Uncompressed images (PGM, PPM and 24-bit BMP) are decoded here; another decoder can be given for other formats.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

SIDE, LOW, LEAST = 32, 8, 32
_NETPBM = re.compile(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode_plain(data: bytes) -> np.ndarray | None:
    """height x width greyscale of an uncompressed image; None for anything else."""
    head = _NETPBM.match(data)
    if head:
        depth = 1 if head[1] == b"P5" else 3
        w, h, top = map(int, head.groups()[1:])
        pixels = np.frombuffer(data, np.uint8, -1, head.end())
        if top != 255 or len(pixels) < w * h * depth:
            return None
        return _grey(pixels[: w * h * depth].reshape(h, w, depth))
    if data[:2] == b"BM" and len(data) >= 54:
        at, (w, h, _, bits, packed) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<iiHHI", data, 18)
        row = (w * 3 + 3) // 4 * 4
        if bits != 24 or packed or w <= 0 or not h or len(data) < at + row * abs(h):
            return None
        rows = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * 3].reshape(abs(h), w, 3)[:, :, ::-1]
        return _grey(rows[::-1] if h > 0 else rows)
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.float64)
    return np.floor(pixels @ np.array([299.0, 587.0, 114.0]) / 1000)


def _weights(n: int, side: int = SIDE) -> np.ndarray:
    """side x n: a Lanczos filter of three lobes, widened where the image shrinks."""
    scale = max(n / side, 1.0)
    centre = (np.arange(side) + 0.5) * n / side
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def _cosines(side: int = SIDE, low: int = LOW) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(side)[None, :] + 1) * np.arange(low)[:, None] / (2 * side))


def perceptual_hash(data: bytes | None, decode: Callable[[bytes], np.ndarray | None] = decode_plain) -> str | None:
    """16 hex digits; None for what can't be decoded, or is smaller than LEAST pixels in a dimension."""
    try:
        grey = decode(data) if data else None
    except (ValueError, struct.error):
        return None
    if grey is None or min(grey.shape) < LEAST:
        return None
    small = np.clip(np.rint(_weights(grey.shape[0]) @ grey @ _weights(grey.shape[1]).T), 0, 255)
    low = _cosines() @ small @ _cosines().T
    return f"{int(''.join('1' if b else '0' for b in (low > np.median(low)).ravel()), 2):016x}"


def image_hashes(images: DataFrame, decode: Callable[[bytes], np.ndarray | None] = decode_plain) -> DataFrame:
    """(path, phash) of images (path, content), as spark.read.format("binaryFile") gives them."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([perceptual_hash(x, decode) for x in batch.column(1).to_pylist()], pa.string())], ["path", "phash"])

    return images.select("path", "content").mapInArrow(scan, "path string, phash string")
