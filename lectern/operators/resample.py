"""Sizes and contrast of grey images held as arrays of levels (0 to 255, row by row): thumbnails, stored sizes, preparation for recognition.

Each image is an array of its own, worked on by numpy in Arrow batches; images of one size share their weights. Results are null
for a null image, for one whose number of levels isn't rows x columns, and for one with a null level.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest edges of a stored image and of a thumbnail, the least longest edge for
# recognition, the most that it is enlarged, and the share of levels in percent cut at each end.
STORED_EDGE, THUMBNAIL_EDGE, LEAST_EDGE, MOST_SCALE, CUTOFF = 2048, 256, 1600, 4.0, 1
IMAGE = "struct<rows:int,columns:int,levels:binary>"


@lru_cache(256)
def weights(before: int, after: int) -> np.ndarray:
    """after x before: each new place's share of the old ones; rows sum to 1.

    Smaller: the mean over the area that a new place covers. Larger: linear between the centres of the two nearest.
    """
    if after <= before:
        edges = np.arange(after + 1) * (before / after)
        cells = np.arange(before)
        overlap = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
        shares = np.maximum(overlap, 0.0)
    else:
        at = np.clip((np.arange(after) + 0.5) * (before / after) - 0.5, 0, before - 1)
        shares = np.maximum(1 - np.abs(at[:, None] - np.arange(before)), 0.0)
    return shares / shares.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Separable: first the axis that shrinks the image more. Halves are rounded up."""
    if image.shape == (rows, columns):
        return image
    down, across = weights(image.shape[0], rows), weights(image.shape[1], columns)
    real = down @ image @ across.T if rows * image.shape[1] <= image.shape[0] * columns else down @ (image @ across.T)
    # a mean that lies a rounding error under a half is that half
    return np.floor(real + 0.5 + 1e-9).clip(0, 255).astype(np.uint8)


def fitted(rows: int, columns: int, most: int) -> tuple[int, int]:
    """The size with its longest edge cut to `most` and its aspect kept; no edge falls under 1."""
    longest = max(rows, columns)
    if longest <= most:
        return rows, columns
    return tuple(max(1, (2 * n * most + longest) // (2 * longest)) for n in (rows, columns))


def contrasted(image: np.ndarray, cutoff: float = CUTOFF) -> np.ndarray:
    """Levels stretched to 0..255 after `cutoff` percent of the pixels is left out at each end; images of one level stay."""
    counts = np.bincount(image.ravel(), minlength=256)
    cut = int(image.size * cutoff // 100)
    # the first level from either end that more pixels reach than are cut
    low = int(np.argmax(np.cumsum(counts) > cut))
    high = 255 - int(np.argmax(np.cumsum(counts[::-1]) > cut))
    if high <= low:
        return image
    return np.floor((np.arange(256) - low) * 255 / (high - low)).clip(0, 255).astype(np.uint8)[image]


def sharpened(image: np.ndarray) -> np.ndarray:
    """Each inner pixel against its eight neighbours (32 of itself less 2 of each, by 16); the border stays."""
    if min(image.shape) < 3:
        return image
    whole = image.astype(np.int32)
    total = sum(whole[i : i + image.shape[0] - 2, j : j + image.shape[1] - 2] for i in range(3) for j in range(3))
    out = image.copy()
    out[1:-1, 1:-1] = np.floor((34 * whole[1:-1, 1:-1] - 2 * total) / 16 + 0.5).clip(0, 255)
    return out


def prepared(image: np.ndarray) -> np.ndarray:
    """Enlarged to LEAST_EDGE, by MOST_SCALE at most, with contrast and sharpness."""
    longest = max(image.shape)
    if longest < LEAST_EDGE:
        scale = min(LEAST_EDGE / longest, MOST_SCALE)
        image = resized(image, *(max(1, int(n * scale)) for n in image.shape))
    return sharpened(contrasted(image))


def _over(step):
    """A column function that applies step to each image (levels, rows, columns)."""

    @F.pandas_udf(IMAGE)
    def run(levels: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.DataFrame:
        out = []
        for own, r, c in zip(levels, rows, columns, strict=True):
            made = None
            if own is not None and r == r and c == c and r is not None and c is not None and r > 0 and c > 0 and len(own) == r * c:
                flat = np.frombuffer(own, np.uint8) if isinstance(own, (bytes, bytearray)) else np.asarray(own, float)
                if np.isfinite(flat).all():
                    made = step(flat.clip(0, 255).astype(np.uint8).reshape(int(r), int(c)))
            out.append((None, None, None) if made is None else (*made.shape, made.tobytes()))
        return pd.DataFrame(out, columns=["rows", "columns", "levels"]).astype({"rows": "Int32", "columns": "Int32"})

    return run


def fit(levels: Column, rows: Column, columns: Column, most: int = STORED_EDGE) -> Column:
    """The image with its longest edge at `most`, as a struct of rows, columns and levels (bytes). levels: bytes, or an array of numbers that are cut to 0..255."""
    image = _over(lambda x: resized(x, *fitted(*x.shape, most)))(levels, rows, columns)
    return F.when(image["levels"].isNotNull(), image)


def thumbnail(levels: Column, rows: Column, columns: Column) -> Column:
    return fit(levels, rows, columns, THUMBNAIL_EDGE)


def prepare(levels: Column, rows: Column, columns: Column) -> Column:
    """The image as recognition wants it, with the flag `upscaled`."""
    image = _over(prepared)(levels, rows, columns)
    return F.when(image["levels"].isNotNull(), image.withField("upscaled", F.greatest(rows, columns) < LEAST_EDGE))


def contrast(levels: Column, rows: Column, columns: Column, cutoff: float = CUTOFF) -> Column:
    image = _over(lambda x: contrasted(x, cutoff))(levels, rows, columns)
    return F.when(image["levels"].isNotNull(), image)
