"""Pixel rows as square grids, 3x3 mean filter and Sobel edges.

An image is one row holding an ``array<double>`` of S*S pixels (row-major,
index i*S+j) - never S*S columns. The filters are one numpy stencil over the flat
buffer of an Arrow batch, ``PIXELS`` of it at once; reshaping is a per-row
expression. Nothing is shuffled.

Fixed semantics of the source programs:
* mean filter: interior pixel = round-half-even(sum of the 3x3 block / 9),
  border pixels copied unchanged;
* Sobel: standard 3x3 kernels, magnitude sqrt(gx^2 + gy^2) clipped at 255
  before half-even rounding; border pixels 0;
* a row that does not hold S*S pixels is no image: reshaping and filters give
  NULL for it, and the image chains (C5) drop it, as the source programs do. A
  missing pixel (NULL or NaN) makes the pixels computed from it NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestats.operators.rows import row_length_filter

# The 3x3 Sobel kernels, rows top to bottom.
SOBEL_GX = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_GY = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
SOBEL_CLIP = 255.0
#: Pixels a kernel works on at once: it holds some arrays of that size.
PIXELS = 1 << 18


def grid_reshape(px: Column, size: int) -> Column:
    """Flat S*S array -> S arrays of S (row-major); NULL for another length."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.slice(px, i * size + 1, F.lit(size)))
    return F.when(F.size(px) == size * size, rows)


def grid_flatten(grid: Column) -> Column:
    """S x S -> flat S*S array; inverse of ``grid_reshape``."""
    return F.flatten(grid)


def _weighted(img: np.ndarray, weights: list[list[int]]) -> np.ndarray:
    """Sum over the 3x3 block of every interior pixel, in the source loop's order."""
    n = img.shape[1]
    total = np.zeros((len(img), n - 2, n - 2))
    for i in range(3):
        for j in range(3):
            if weights[i][j]:
                total += weights[i][j] * img[:, i:n - 2 + i, j:n - 2 + j]
    return total


def mean_pixels(img: np.ndarray) -> np.ndarray:
    """Mean filter of images (n, S, S)."""
    out = img.copy()
    if img.shape[1] > 2:
        out[:, 1:-1, 1:-1] = np.rint(_weighted(img, [[1] * 3] * 3) / 9.0)
    return out


def sobel_pixels(img: np.ndarray) -> np.ndarray:
    """Sobel edges of images (n, S, S)."""
    out = np.zeros_like(img)
    if img.shape[1] > 2:
        gx, gy = _weighted(img, SOBEL_GX), _weighted(img, SOBEL_GY)
        out[:, 1:-1, 1:-1] = np.rint(np.minimum(np.sqrt(gx * gx + gy * gy), SOBEL_CLIP))
    return out


def _filtered(rows: pa.Array, size: int, kernel) -> pa.Array:
    """A kernel over the rows that are images; the others become NULL."""
    area = size * size
    fits = pc.fill_null(pc.equal(pc.list_value_length(rows), area), False)
    pixels = (rows if pc.all(fits).as_py() else rows.filter(fits)).flatten()
    out = np.empty(len(pixels))
    step = max(1, PIXELS // area) * area
    for at in range(0, len(pixels), step):
        some = np.asarray(pixels.slice(at, step).to_numpy(zero_copy_only=False), np.float64)
        out[at:at + step] = kernel(some.reshape(-1, size, size)).reshape(-1)
    offsets = np.concatenate([[0], np.cumsum(fits.to_numpy(zero_copy_only=False).astype(np.int32) * area)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, from_pandas=True), mask=pc.invert(fits))


def _stencil(px: Column, size: int, kernel) -> Column:
    @F.arrow_udf("array<double>")
    def run(rows: pa.Array) -> pa.Array:
        return _filtered(rows, size, kernel)

    return run(px)


def mean3x3(px: Column, size: int) -> Column:
    """C3 on a flat ``array<double>`` of pixels."""
    return _stencil(px, size, mean_pixels)


def sobel(px: Column, size: int) -> Column:
    """C4 on a flat ``array<double>`` of pixels."""
    return _stencil(px, size, sobel_pixels)


def _grid_stencil(grid: Column, size: int, kernel) -> Column:
    """The same over S x S grids: flat inside, rows of S again on the way out."""
    @F.arrow_udf("array<array<double>>")
    def run(rows: pa.Array) -> pa.Array:
        flat = _filtered(rows, size, kernel)
        pixels = flat.flatten()
        lines = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pixels) + 1, size), pa.int32()), pixels)
        offsets = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False).astype(np.int32) * size)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines, mask=flat.is_null())

    return run(grid_flatten(grid))


def grid_mean3x3(grid: Column, size: int) -> Column:
    """C3 on a grid."""
    return _grid_stencil(grid, size, mean_pixels)


def grid_sobel(grid: Column, size: int) -> Column:
    """C4 on a grid."""
    return _grid_stencil(grid, size, sobel_pixels)


def _image_chain(df: DataFrame, cells_col: str, size: int, kernel) -> DataFrame:
    cast = df.withColumn(cells_col, F.col(cells_col).cast("array<double>"))
    kept = row_length_filter(cast, cells_col, size * size)
    at = kept.columns.index(cells_col)

    step = max(1, PIXELS // (size * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, step):
                some = b.slice(k, step)
                yield some.set_column(at, cells_col, _filtered(some.column(at), size, kernel))

    return kept.mapInArrow(run, kept.schema)


def smooth_images(df: DataFrame, cells_col: str, size: int = 32) -> DataFrame:
    """Cast cells to numbers (raises on text), drop rows of the wrong
    length, 3x3 mean over the flat pixels."""
    return _image_chain(df, cells_col, size, mean_pixels)


def sobel_images(df: DataFrame, cells_col: str, size: int = 32) -> DataFrame:
    """C5 with Sobel edges instead of the mean filter."""
    return _image_chain(df, cells_col, size, sobel_pixels)
