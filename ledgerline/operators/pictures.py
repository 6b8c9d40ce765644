"""Pictures: difference hashes, decoding and thumbnails.

The hash works on a table of grey pixels and needs no decoder.  Decoding takes
Pillow where it is installed; without it binary PNM files are read by numpy and
every other picture counts as unreadable.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators import cache

WIDTH, HEIGHT = 9, 8


def difference_hash(pixels: Column) -> list[Column]:
    """b0 to b3 of 9 by 8 grey pixels, row by row: bit row * 8 + column is set where a pixel is at least its right neighbour."""
    bands = []
    for band in range(4):
        total = F.lit(0)
        for bit in range(16):
            row, column = divmod(16 * band + bit, 8)
            here = row * WIDTH + column
            total = total + F.when(F.get(pixels, F.lit(here)) >= F.get(pixels, F.lit(here + 1)), 1 << bit).otherwise(0)
        bands.append(total.cast("int").alias(f"b{band}"))
    return bands


def _decode(content: bytes) -> np.ndarray:
    """(height, width, 3) of a picture; ValueError where it cannot be decoded."""
    try:
        from PIL import Image
    except ImportError:
        Image = None
    if Image is not None:
        try:
            return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
        except Exception as error:
            raise ValueError("not a picture") from error
    head = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", content)
    if not head:
        raise ValueError("no decoder for this picture")
    channels = 1 if head[1] == b"5" else 3
    width, height, top = int(head[2]), int(head[3]), int(head[4])
    raw = np.frombuffer(content, dtype=np.uint8, offset=head.end())
    if top != 255 or not width or not height or len(raw) < width * height * channels:
        raise ValueError("truncated or unsupported picture")
    pixels = raw[: width * height * channels].reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels


def _weights(size: int, wanted: int) -> np.ndarray:
    """(wanted, size) Lanczos weights that also smooth when shrinking."""
    scale = max(size / wanted, 1.0)
    centre = (np.arange(wanted) + 0.5) * size / wanted
    x = (np.arange(size) + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels (height, width, ...) at another size, rounded to bytes."""
    rows = np.tensordot(_weights(pixels.shape[0], height), pixels.astype(float), axes=(1, 0))
    both = np.moveaxis(np.tensordot(_weights(pixels.shape[1], width), rows, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def grey_pixels(files: DataFrame) -> DataFrame:
    """(path, pixels): 72 grey values of each picture (path, content); null where it cannot be decoded."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for content in part["content"]:
                try:
                    grey = _decode(bytes(content)) @ np.array([299, 587, 114]) // 1000
                    found.append(resize(grey, WIDTH, HEIGHT).ravel().tolist())
                except (ValueError, TypeError):
                    found.append(None)
            yield pd.DataFrame({"path": part["path"], "pixels": found})

    return files.select("path", "content").mapInPandas(run, "path string, pixels array<int>")


def signatures(files: DataFrame) -> DataFrame:
    """(path, b0..b3, is_unreadable) of pictures (path, content)."""
    return grey_pixels(files).select("path", *difference_hash(F.col("pixels")), F.col("pixels").isNull().alias("is_unreadable"))


def _png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + line.tobytes() for line in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def thumbnails(files: DataFrame, width: int = 60, height: int = 60) -> DataFrame:
    """(path, mtime, size, b64): PNG thumbnails that fit the given size, in base64; null where a picture cannot be decoded."""

    def one(content) -> str | None:
        try:
            pixels = _decode(bytes(content))
        except (ValueError, TypeError):
            return None
        scale = min(1.0, width / pixels.shape[1], height / pixels.shape[0])
        fit = max(1, round(pixels.shape[1] * scale)), max(1, round(pixels.shape[0] * scale))
        return base64.b64encode(_png(resize(pixels, *fit))).decode()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[["path", "mtime", "size"]].assign(b64=[one(c) for c in part["content"]])

    return files.select("path", "mtime", "size", "content").mapInPandas(run, "path string, mtime double, size long, b64 string")


def page_thumbnails(shown: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(thumbnails of the shown files, cache with the new ones): only those that the cache lacks are made."""
    keys = shown.select("path", "mtime", "size")
    made = thumbnails(cache.misses(held, shown)).filter("b64 is not null")
    return cache.hits(held, keys).unionByName(made), cache.upsert(held, made)
