"""Pictures as raw RGB bytes: masks over boxes and comparison of regions, by Arrow-batched numpy.

There is no image codec here; a reader that decodes files only has to yield these bytes.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _region(picture: bytes, width: int, height: int, box) -> tuple[np.ndarray, tuple[slice, slice]]:
    """The picture as an array, and the box within it, one pixel wide and high at least."""
    pixels = np.frombuffer(picture, np.uint8).reshape(height, width, 3)
    x1, y1 = min(max(int(box[0]), 0), width - 1), min(max(int(box[1]), 0), height - 1)
    x2, y2 = min(max(int(box[2]), x1 + 1), width), min(max(int(box[3]), y1 + 1), height)
    return pixels, (slice(y1, y2), slice(x1, x2))


def _blur(part: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur with the edge repeated, first down and then across."""
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = part.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (reach, reach)
        out = np.apply_along_axis(np.convolve, axis, np.pad(out, pad, mode="edge"), kernel, mode="valid")
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def mask_bytes(picture: bytes, width: int, height: int, boxes, strategy: str, sigma: float | None) -> bytes:
    if strategy not in ("none", "black", "white", "blur"):
        raise ValueError(f"unknown strategy {strategy}")
    out = np.frombuffer(picture, np.uint8).reshape(height, width, 3).copy()
    for box in boxes if boxes is not None and strategy != "none" else ():
        _, at = _region(picture, width, height, box)
        out[at] = 0 if strategy == "black" else 255 if strategy == "white" else _blur(out[at], sigma or 12.0)
    return out.tobytes()


@F.pandas_udf(T.BinaryType())
def _mask(picture: pd.Series, width: pd.Series, height: pd.Series, boxes: pd.Series, strategy: pd.Series, sigma: pd.Series) -> pd.Series:
    return pd.Series([mask_bytes(*row) for row in zip(picture, width, height, boxes, strategy, sigma, strict=True)])


@F.pandas_udf(T.BooleanType())
def _differs(a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series, box: pd.Series) -> pd.Series:
    def one(a, b, width, height, box) -> bool:
        left, at = _region(a, width, height, box)
        return bool((left[at] != _region(b, width, height, box)[0][at]).any())

    return pd.Series([one(*row) for row in zip(a, b, width, height, box, strict=True)])


@F.pandas_udf(T.BinaryType())
def _synthetic(seed: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([np.random.default_rng(int(s)).integers(1, 255, (int(h), int(w), 3), np.uint8).tobytes() for s, w, h in zip(seed, width, height, strict=True)])


def mask(picture: Column, width: Column, height: Column, boxes: Column, strategy: Column, sigma: Column) -> Column:
    """The picture with its boxes black, white or blurred one after the other; no boxes or ``none``: as it was."""
    return _mask(picture, width, height, boxes, strategy, sigma)


def differs(a: Column | str, b: Column | str, width: Column, height: Column, box: Column) -> Column:
    """Whether two pictures differ within a box."""
    return _differs(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, width, height, box)


def synthetic(seed: Column, width: Column, height: Column) -> Column:
    """A reproducible picture of noise."""
    return _synthetic(seed, width, height)


def decode_bytes(data: bytes | None) -> tuple[int, int, bytes] | None:
    """Width, height and RGB bytes of a binary PPM or an uncompressed 24-bit BMP file; null for anything else."""
    if data and data[:2] == b"P6":
        found = re.match(rb"P6(?:\s+|#[^\n]*\n)+(\d+)\s+(\d+)\s+(\d+)\s", data)
        if found and int(found[3]) == 255:
            width, height = int(found[1]), int(found[2])
            body = data[found.end() : found.end() + 3 * width * height]
            return (width, height, body) if len(body) == 3 * width * height else None
    if data and data[:2] == b"BM" and len(data) >= 54:
        start, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18)
        bits, packed = struct.unpack_from("<H", data, 28)[0], struct.unpack_from("<I", data, 30)[0]
        line = -(-3 * width // 4) * 4
        if (bits, packed) == (24, 0) and width > 0 and len(data) >= start + line * abs(height):
            rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
            return width, abs(height), (rows[::-1] if height > 0 else rows).tobytes()
    return None


def downscaled(picture: bytes, width: int, height: int, most: int = 1024) -> tuple[int, int, bytes]:
    """A picture whose longer side is ``most`` at most, its shape kept; each pixel is the mean of the area it covers."""
    scale = min(1.0, most / max(width, height))
    if scale == 1.0:
        return width, height, picture
    to = [max(1, round(height * scale)), max(1, round(width * scale))]
    out = np.frombuffer(picture, np.uint8).reshape(height, width, 3).astype(np.float64)
    for axis, (size, n) in enumerate(zip(to, (height, width), strict=True)):
        total = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        edge = np.linspace(0, n, size + 1)
        low, part = np.minimum(edge.astype(int), n - 1), edge - np.minimum(edge.astype(int), n - 1)
        shape = [-1 if i == axis else 1 for i in range(3)]
        upto = total.take(low, axis) + out.take(low, axis) * part.reshape(shape)
        out = np.diff(upto, axis=axis) * size / n
    return to[1], to[0], np.clip(np.rint(out), 0, 255).astype(np.uint8).tobytes()


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("picture", T.BinaryType())]))
def _decoded(data: pd.Series, most: pd.Series) -> pd.DataFrame:
    found = [decode_bytes(x) for x in data]
    return pd.DataFrame([downscaled(x[2], x[0], x[1], m) if x else (None, None, None) for x, m in zip(found, most, strict=True)], columns=["width", "height", "picture"]).astype({"width": "Int32", "height": "Int32"})


def decoded(data: Column, most: int = 1024) -> Column:
    """(width, height, picture) of a file's bytes, as Spark's ``binaryFile`` source reads them, scaled down to ``most``
    at the longer side; nulls where the file can't be read."""
    return _decoded(data, F.lit(most))
