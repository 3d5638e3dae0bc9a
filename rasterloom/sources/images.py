"""Image files to rasters: Spark reads the files, a small decoder per file yields pixel rows.

BMP (24 and 32 bits, either direction) is decoded here; PNG and JPEG go through Spark's own image
source.  Files are split over tasks by Spark; one file is one row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER = "img string, i bigint, x int, y int, r int, g int, b int, a int"
#: Longest side; larger images are refused, since a working image is at most 1,200 wide.
LONGEST = 16_384


def kind_of(content: bytes) -> str:
    for magic, kind in ((b"BM", "bmp"), (b"\xff\xd8", "jpeg"), (b"\x89PNG", "png")):
        if content.startswith(magic):
            return kind
    raise ValueError("unknown image format")


def decode_bmp(content: bytes) -> np.ndarray:
    """height x width x 4 bytes, RGBA from the top."""
    start, (width, height), bits, packed = struct.unpack_from("<I", content, 10)[0], struct.unpack_from("<ii", content, 18), struct.unpack_from("<H", content, 28)[0], struct.unpack_from("<I", content, 30)[0]
    if bits not in (24, 32) or packed not in (0, 3) or max(width, abs(height)) > LONGEST:
        raise ValueError("only plain BMP files of 24 or 32 bits are read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    if height > 0:
        rows = rows[::-1]
    out = np.full((abs(height), width, 4), 255, np.uint8)
    out[..., :3] = rows[..., 2::-1] if bits == 24 else rows[..., [2, 1, 0]]
    return out


def _pixels(name: str, rgba: np.ndarray) -> pd.DataFrame:
    y, x = np.divmod(np.arange(rgba.shape[0] * rgba.shape[1]), rgba.shape[1])
    flat = rgba.reshape(-1, 4)
    return pd.DataFrame({"img": name, "i": y * rgba.shape[1] + x, "x": x.astype(np.int32), "y": y.astype(np.int32), **{c: flat[:, k].astype(np.int32) for k, c in enumerate("rgba")}})


def read_bmp(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows of all BMP files of a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                if kind_of(content) != "bmp":
                    raise ValueError(f"{name} is no BMP file")
                yield _pixels(name.rpartition("/")[2], decode_bmp(content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RASTER)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows of all PNG and JPEG files of a path, by Spark's image source (stored as BGR)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                data = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                rgba = np.full((r.height, r.width, 4), 255, np.uint8)
                rgba[..., :3] = data[..., :3][..., ::-1] if r.nChannels >= 3 else data[..., :1]
                if r.nChannels == 4:
                    rgba[..., 3] = data[..., 3]
                yield _pixels(r.origin.rpartition("/")[2], rgba)

    return spark.read.format("image").load(path).select("image.*").mapInPandas(run, RASTER)
