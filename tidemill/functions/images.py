"""Gates and sizes of images from their metadata; sharpness from pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The gate's limits in pixels, bytes and variance, and the least side to answer on.
MIN_SIDE, MIN_BYTES, MAX_BYTES, MIN_SHARPNESS = 512, 20 * 1024, 5 * 1024 * 1024, 80.0
LEAST_SIDE = 10
GROWN_SIDE = 224


def acceptable(width: Column, height: Column, size: Column, sharpness: Column) -> Column:
    """Not small on both sides, neither tiny nor huge as a file, and sharp."""
    small = (width < MIN_SIDE) & (height < MIN_SIDE)
    return ~small & size.between(MIN_BYTES, MAX_BYTES) & (sharpness >= MIN_SHARPNESS)


def usable(width: Column, height: Column) -> Column:
    return (width >= LEAST_SIDE) & (height >= LEAST_SIDE)


def within_pixels(width: Column, height: Column, least: int, most: int) -> Column:
    """Width and height as a struct, scaled alike into a range of pixels and cut to whole numbers."""
    pixels = width * height
    factor = F.when(pixels > most, F.sqrt(F.lit(most) / pixels)).when(pixels < least, F.sqrt(F.lit(least) / pixels)).otherwise(F.lit(1.0))
    return F.struct((width * factor).cast("int").alias("width"), (height * factor).cast("int").alias("height"))


def at_least_side(width: Column, height: Column, side: int = GROWN_SIDE) -> Column:
    """Scaled up alike until the shorter side has a length."""
    factor = F.greatest(F.lit(1.0), F.lit(side) / F.least(width, height))
    return F.struct((width * factor).cast("int").alias("width"), (height * factor).cast("int").alias("height"))


def laplacian_variance(pixels: np.ndarray, width: int) -> float:
    """Variance of the four-neighbour Laplacian within the image, from its pixels row after row: sums of shifted views, without a copy of any row."""
    height = len(pixels) // width if width else 0
    if min(height, width) < 3:
        return 0.0
    image = pixels.reshape(height, width)
    inner = image[1:-1, 1:-1] * -4.0
    for part in (image[:-2, 1:-1], image[2:, 1:-1], image[1:-1, :-2], image[1:-1, 2:]):
        inner += part
    return float(inner.var())


@F.pandas_udf(T.DoubleType())
def _sharpness(pixels: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else laplacian_variance(np.asarray(p, float), int(w)) for p, w in zip(pixels, width, strict=True)], dtype="float64")


def sharpness(rows: Column) -> Column:
    """Of grey pixels as an array of rows of equal length: these go to the kernel as one flat array; null for null, 0 below three rows or columns."""
    return _sharpness(F.flatten(rows), F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0)))
