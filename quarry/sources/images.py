"""Pixels of simple image formats, and their perceptual hash."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sides of the picture that is transformed, and of the corner of low frequencies that is kept.
SIDE, KEPT = 32, 8
#: Pixels of the largest picture that is decoded.
MOST_PIXELS = 1 << 26


def _png(data: bytes) -> np.ndarray | None:
    """Grey values of a PNG without interlacing, of 8 bits a channel or a palette."""
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if interlaced or depth != 8 or width * height > MOST_PIXELS:
        return None
    at, packed, palette = 8, [], None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    rows = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        line = raw[y, 1:].astype(np.int64)
        how = raw[y, 0]
        if how == 1:
            line = np.cumsum(line.reshape(-1, channels), axis=0).reshape(-1)
        elif how == 2:
            line = line + above
        elif how in (3, 4):
            up = above.astype(np.int64)
            for x in range(len(line)):
                left = line[x - channels] & 255 if x >= channels else 0
                corner = up[x - channels] if x >= channels else 0
                if how == 3:
                    line[x] += (left + up[x]) // 2
                else:
                    guess = left + up[x] - corner
                    by = (abs(guess - left), abs(guess - up[x]), abs(guess - corner))
                    line[x] += (left, up[x], corner)[by.index(min(by))]
        rows[y] = above = (line & 255).astype(np.uint8)
    pixels = rows.reshape(height, width, channels)
    if kind == 3:
        pixels = palette[pixels[:, :, 0]]
    return _grey(pixels[:, :, :3] if pixels.shape[2] >= 3 else pixels[:, :, :1])


def _bmp(data: bytes) -> np.ndarray | None:
    start, = struct.unpack("<I", data[10:14])
    width, height, _, bits, packed = struct.unpack("<iiHHI", data[18:34])
    if bits not in (24, 32) or packed not in (0, 3) or width * abs(height) > MOST_PIXELS:
        return None
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    pixels = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return _grey(pixels[::-1] if height > 0 else pixels)


def _pnm(data: bytes) -> np.ndarray | None:
    fields = data[:256].split(None, 4)
    kind, width, height = fields[0], int(fields[1]), int(fields[2])
    channels = {b"P5": 1, b"P6": 3}[kind]
    body = data[len(data) - width * height * channels :]
    return _grey(np.frombuffer(body, np.uint8).reshape(height, width, channels)) if width * height <= MOST_PIXELS else None


def _grey(pixels: np.ndarray) -> np.ndarray:
    return pixels[:, :, 0].astype(float) if pixels.shape[2] == 1 else pixels @ np.array([0.299, 0.587, 0.114])


def grey(data: bytes) -> np.ndarray | None:
    """Grey values (rows by columns) of a PNG, BMP or binary PGM or PPM picture; None of any other or a broken one."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] == b"BM":
            return _bmp(data)
        return _pnm(data) if data[:2] in (b"P5", b"P6") else None
    except (ValueError, IndexError, KeyError, struct.error, zlib.error, TypeError):
        return None


def _shrunk(picture: np.ndarray, axis: int) -> np.ndarray:
    """Means of SIDE stretches of equal length along *axis*; each is one pixel at least."""
    n = picture.shape[axis]
    edges = np.linspace(0, n, SIDE + 1)
    sums = np.concatenate([np.zeros_like(picture.take([0], axis)), np.cumsum(picture, axis)], axis)
    low = np.minimum(np.floor(edges).astype(int), n - 1)
    at = sums.take(low, axis) + picture.take(low, axis) * np.moveaxis((edges - low).reshape(-1, 1), 0, axis).reshape([-1 if a == axis else 1 for a in range(2)])
    return np.diff(at, axis=axis) / (n / SIDE)


def phash(data: bytes) -> str | None:
    """16 hexadecimal digits: which of the lowest frequencies of the picture's cosine transform are above their median."""
    picture = grey(data)
    if picture is None or 0 in picture.shape:
        return None
    small = _shrunk(_shrunk(picture, 0), 1)
    k = np.arange(SIDE)
    base = np.cos(np.pi / SIDE * (k[None, :] + 0.5) * k[:KEPT, None])
    low = (base @ small @ base.T).reshape(-1)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def with_phash(files: DataFrame) -> DataFrame:
    """*files* (content_type, content) with phash for images that can be decoded."""

    @F.pandas_udf("string")
    def own(content: pd.Series) -> pd.Series:
        return pd.Series([phash(bytes(x)) if x is not None else None for x in content], dtype=object)

    return files.withColumn("phash", F.when(F.col("content_type").startswith("image/"), own(F.when(F.col("content_type").startswith("image/"), F.col("content")))))
