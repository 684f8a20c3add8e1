"""Pixels: Spark's image source, quality metrics and difference hashes, in numpy per Arrow batch; sizes from headers alone.

The reader knows what Java's ImageIO knows; anything else has height -1 and gets null metrics.  The size of a WebP file, which it
doesn't know, comes from the header.
The resampling is this package's own: hashes are comparable with each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.headers import image_header

LONGEST = 512
HASH_SIDE = 8
# Kinds that are images though the reader can't decode them.
UNREAD = ("webp",)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, channels, pixels``; pixels are null for what can't be decoded."""
    image = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    good = F.col("height") > 0
    return image.select(F.col("origin").alias("path"), *[F.when(good, F.col(c)).otherwise(0).alias(c) for c in ("width", "height")], F.col("nChannels").alias("channels"), F.when(good, F.col("data")).alias("pixels"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, kind, width, height`` of the files below ``path``, by their first bytes; what is no image has nulls.

    It serves as ``decoded`` of ``attach_sidecars`` and as ``headers`` of ``image_metrics``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), image_header(F.col("content")).alias("_header")).select("path", "size", "_header.*")


def luma(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Rounded ITU-R 601 luma of blue-green-red rows."""
    raw = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return raw[:, :, 0]
    return np.round(0.114 * raw[:, :, 0] + 0.587 * raw[:, :, 1] + 0.299 * raw[:, :, 2])


def _kernel(x: np.ndarray, lobes: int) -> np.ndarray:
    """Lanczos for three lobes, a triangle for one."""
    x = np.abs(x)
    return np.where(x < lobes, np.sinc(x) * np.sinc(x / lobes) if lobes > 1 else 1 - x, 0.0)


def resized(gray: np.ndarray, width: int, height: int, lobes: int) -> np.ndarray:
    """Separable resampling; when shrinking, the kernel widens with the scale."""
    for axis, size in ((1, width), (0, height)):
        n = gray.shape[axis]
        scale = max(1.0, n / size)
        centre = (np.arange(size) + 0.5) * n / size - 0.5
        w = _kernel((np.arange(n)[None, :] - centre[:, None]) / scale, lobes)
        w /= w.sum(axis=1, keepdims=True)
        gray = gray @ w.T if axis == 1 else w @ gray
    return np.clip(np.round(gray), 0, 255)


def sharpness(gray: np.ndarray) -> float:
    """Variance of the 8-neighbour Laplacian at a bounded size; borders keep their pixels."""
    if max(gray.shape) > LONGEST:
        f = LONGEST / max(gray.shape)
        gray = resized(gray, max(1, int(gray.shape[1] * f)), max(1, int(gray.shape[0] * f)), 1)
    out = gray.copy()
    if min(gray.shape) >= 3:
        around = sum(gray[1 + i : gray.shape[0] - 1 + i, 1 + j : gray.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
        out[1:-1, 1:-1] = np.clip(8 * gray[1:-1, 1:-1] - around, 0, 255)
    return float(out.var())


def difference_hash(gray: np.ndarray) -> str:
    small = resized(gray, HASH_SIDE + 1, HASH_SIDE, 3)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def image_metrics(images: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """``path, width, height, blur, brightness, contrast, phash`` of each image.

    With ``headers (path, kind, width, height)`` the images that the reader can't decode, but that aren't broken, have their sizes."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.pixels is None:
                    rows.append((r.path, 0, 0, None, None, None, None))
                    continue
                gray = luma(r.pixels, r.width, r.height, r.channels)
                rows.append((r.path, r.width, r.height, sharpness(gray), float(gray.mean()), float(gray.std()), difference_hash(gray)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "blur", "brightness", "contrast", "phash"])

    out = images.mapInPandas(measure, "path string, width int, height int, blur double, brightness double, contrast double, phash string")
    if headers is None:
        return out
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  # the two readers write local paths in two ways
    told = headers.filter(F.col("kind").isin(*UNREAD) & F.col("width").isNotNull())
    told = told.select(plain("path").alias("_path"), F.col("width").alias("_width"), F.col("height").alias("_height")).dropDuplicates(["_path"])
    out = out.join(told, plain("path") == F.col("_path"), "left")
    unread = F.col("blur").isNull() & F.col("_width").isNotNull()
    return out.withColumns({c: F.when(unread, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("width", "height")}).drop("_path", "_width", "_height")
