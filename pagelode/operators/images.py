"""Image preparation: arithmetic over pixel counts, and the clean-up of pixels before text is recognised in them.

Pixels are rows of bytes, grey or red-green-blue; files are read and written by a boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The strengths of contrast and sharpness, the middle grey, and the weights of colours and of smoothing.
CONTRAST, SHARPNESS, MIDDLE = 1.5, 2.0, 127
GREY = (0.299, 0.587, 0.114)
SMOOTH = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13


def histogram(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Pixels of each grey value (0-255), combined before the shuffle."""
    return pixels.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def otsu_threshold(counts: DataFrame, keys: list[str]) -> DataFrame:
    """For each image the grey value that parts its pixels with the greatest variance between the two sides; the first of equals.

    Running sums over at most 256 rows an image.
    """
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    n, v = F.col("n"), F.col("value")
    sums = counts.select(*keys, "value", F.sum(n).over(upto).alias("w0"), F.sum(n * v).over(upto).alias("s0"), F.sum(n).over(whole).alias("w"), F.sum(n * v).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0))
    between = F.when(w1 > 0, F.col("w0").cast("double") * w1 * gap * gap).otherwise(0.0)
    scored = sums.withColumn("between", F.round(between, 6))
    return scored.groupBy(*keys).agg(F.max_by("value", F.struct("between", -F.col("value"))).alias("threshold"))


def is_dark(counts: DataFrame, keys: list[str], middle: int = 127) -> DataFrame:
    """Whether an image's mean grey value lies below the middle, so that it is to be inverted."""
    return counts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("value")) / F.sum("n") < middle).alias("dark"))


def _around(image: np.ndarray) -> np.ndarray:
    """Each pixel's nine neighbours, itself included; the border is repeated beyond the edge."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, 1, mode="edge"), (3, 3))


def _blend(low: np.ndarray | float, image: np.ndarray, factor: float) -> np.ndarray:
    """Away from ``low`` by a factor, within what a byte holds."""
    return np.clip(low + factor * (image.astype(float) - low), 0, 255).astype(np.uint8)


def threshold(image: np.ndarray) -> int:
    """As ``otsu_threshold``, of one image."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.argmax(np.nan_to_num(np.round(between, 6))))


def cleaned(image: np.ndarray, contrast: float = CONTRAST, sharpness: float = SHARPNESS) -> np.ndarray:
    """Black text on white: grey, more contrast, sharper, two tones, no specks, and turned over where dark."""
    grey = np.round(image @ np.array(GREY)).astype(np.uint8) if image.ndim == 3 else image
    strong = _blend(float(np.floor(grey.mean() + 0.5)), grey, contrast)
    smooth = np.floor((_around(strong) * SMOOTH).sum((-1, -2)) + 0.5)
    sharp = _blend(smooth, strong, sharpness)
    tones = np.where(sharp > threshold(sharp), 255, 0).astype(np.uint8)
    calm = np.median(_around(tones), axis=(-1, -2)).astype(np.uint8)
    return 255 - calm if calm.mean() < MIDDLE else calm


def clean_images(images: DataFrame, contrast: float = CONTRAST, sharpness: float = SHARPNESS) -> DataFrame:
    """Images (image, width, height, pixels) made ready for text recognition: their grey pixels, or those they had and the error."""
    kind = images.schema["image"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, errors = [], []
            for width, height, data in zip(*(batch.column(n).to_pylist() for n in ("width", "height", "pixels")), strict=True):
                try:
                    flat = np.frombuffer(data, np.uint8)
                    shape = (height, width) if len(flat) == height * width else (height, width, 3)
                    pixels.append(cleaned(flat.reshape(shape), contrast, sharpness).tobytes())
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  an image that cannot be cleaned is used as it is
                    pixels.append(data)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("width"), batch.column("height"), pa.array(pixels, pa.binary()), pa.array(errors, pa.string())], names=["image", "width", "height", "pixels", "error"])

    used = images.select("image", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    return used.mapInArrow(run, f"image {kind}, width int, height int, pixels binary, error string")
