"""Images as arrays: PNG and BMP by their formats, others where a reader is installed."""

from __future__ import annotations

import base64
import io
import struct
import zlib

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from kindred.functions.hashing import by_path, image_bits


class UnsupportedImage(ValueError):
    pass


# PNG channels by colour type, and the passes of an interlaced one (first column and
# row, steps between columns and rows).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """Scan lines without their prediction from the left, upper and upper left byte."""
    out, above, at = np.zeros((rows, stride), np.uint8), np.zeros(stride, np.uint8), 0
    for y in range(rows):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1).copy()
        at += stride + 1
        if kind == 2:
            line += above
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.add.accumulate(line[k::step], dtype=np.uint8)
        elif kind in (3, 4):
            line, up = line.tolist(), above.tolist()
            for x in range(stride):
                a, b, c = line[x - step] if x >= step else 0, up[x], up[x - step] if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                    guess = (a, b, c)[near.index(min(near))]
                line[x] = (line[x] + guess) & 255
            line = np.array(line, np.uint8)
        elif kind:
            raise UnsupportedImage("PNG filter")
        out[y] = above = line
    return out


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """(rows, width, channels) of 8-bit samples, or of palette places and scaled bits below 8."""
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        lines = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return lines[:, : width * channels].reshape(len(lines), width, channels)


def png(content: bytes) -> np.ndarray:
    at, head, palette, data = 8, None, None, []
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[3] not in CHANNELS:
        raise UnsupportedImage("PNG header")
    width, height, depth, colour, *_, interlaced = head
    raw, channels = zlib.decompress(b"".join(data)), CHANNELS[colour]
    out, step, at = np.zeros((height, width, channels), np.uint8), max(1, depth * channels // 8), 0
    for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            stride = (w * channels * depth + 7) // 8
            out[y::dy, x::dx] = _samples(_unfiltered(raw[at : at + h * (stride + 1)], h, stride, step), w, depth, channels)
            at += h * (stride + 1)
    if colour == 3:
        return palette[out[:, :, 0]]
    if depth < 8:
        out = (out.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return out[:, :, : 3 if channels > 2 else 1]


def bmp(content: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packing = struct.unpack("<IIiiHHI", content[10:34])
    if bits not in (24, 32) or packing not in (0, 3):
        raise UnsupportedImage("BMP kind")
    stride = (width * bits // 8 + 3) // 4 * 4
    lines = np.frombuffer(content, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    pixels = lines[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decoded(content: bytes) -> np.ndarray:
    """(rows, columns, 1 or 3) of 8-bit samples."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return png(content)
        if content[:2] == b"BM":
            return bmp(content)
    except (struct.error, zlib.error, IndexError, TypeError, ValueError) as e:
        raise UnsupportedImage(str(e)) from e
    try:
        from PIL import Image
    except ImportError as e:
        raise UnsupportedImage("no reader for this format") from e
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except OSError as e:
        raise UnsupportedImage(str(e)) from e


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of the colours."""
    return pixels[:, :, 0].astype(float) if pixels.shape[2] < 3 else pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def resized(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over the areas that the new pixels cover; axes after the first two stay."""
    for axis, n in ((0, rows), (1, columns)):
        m = image.shape[axis]
        edges = np.arange(n + 1) * m / n
        low, high = edges[:-1, None], edges[1:, None]
        cover = np.clip(np.minimum(high, np.arange(m) + 1) - np.maximum(low, np.arange(m)), 0, None) * n / m
        image = np.moveaxis(np.tensordot(cover, image, (1, axis)), 0, axis)
    return image


def _told(content: bytes, algorithm: str) -> int | None:
    try:
        return image_bits(gray(decoded(content)), algorithm)
    except UnsupportedImage:
        return None


def image_hash(algorithm: str):
    """A column function of paths: struct of the hash, as a text of the long, and an error; an
    image that cannot be decoded has neither."""
    def of(path, f):
        told = _told(f.read(), algorithm)
        return None if told is None else str(told)

    return by_path(of)


def content_hash(algorithm: str):
    """A column function of contents: the hash; null for null and for what cannot be decoded."""
    @F.pandas_udf("long")
    def of(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _told(bytes(c), algorithm) for c in contents], dtype="Int64")

    return of


def as_png(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape
    lines = np.zeros((h, 1 + w * channels), np.uint8)
    lines[:, 1:] = pixels.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def thumbnail(content: bytes, most: int = 100) -> str | None:
    """The image at ``most`` pixels a side or less, as a data URI; None if it cannot be decoded."""
    try:
        pixels = decoded(content)
    except UnsupportedImage:
        return None
    h, w = pixels.shape[:2]
    scale = min(1.0, most / max(h, w))
    small = resized(pixels, max(1, round(h * scale)), max(1, round(w * scale)))
    return "data:image/png;base64," + base64.b64encode(as_png(np.clip(small + 0.5, 0, 255).astype(np.uint8))).decode()
