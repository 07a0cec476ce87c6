"""Image folders to pixel rows, and checks on pixel rows.

Images are read by Spark's ``image`` source (decoding happens on the
executors; unreadable files are dropped). Grey conversion and the area
resize run in an Arrow UDF with numpy, on all images of one size in a batch at
once - the only Python stage, since Spark has no function that turns image
bytes into numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablestats.sources.cells import FLOAT_RE, SPECIAL_RE

# 8-bit BGR -> grey weights (0.299 R + 0.587 G + 0.114 B) in
# 14-bit fixed point with rounding, as OpenCV computes them.
GREY_SHIFT = 14
GREY_B, GREY_G, GREY_R = 1868, 9617, 4899


def _area_matrix(src: int, dst: int) -> np.ndarray:
    """Weights of source cells in each destination cell (rows sum to 1)."""
    w = np.zeros((dst, src))
    scale = src / dst
    for d in range(dst):
        lo, hi = d * scale, (d + 1) * scale
        for s in range(int(np.floor(lo)), int(np.ceil(hi))):
            w[d, s] = max(0.0, min(hi, s + 1) - max(lo, s))
    return w / scale


def grey_resize_many(images: np.ndarray, size: int) -> np.ndarray:
    """Images of one size, uint8 (n, height, width, channels; BGR, BGRA or grey) -> (n, S*S) grey pixels."""
    n, height, width, channels = images.shape
    if channels == 1:
        grey = images[:, :, :, 0].astype(np.int64)
    else:
        # Whole numbers throughout: a weighted sum of the three planes, shifted.
        grey = sum(images[:, :, :, k].astype(np.int64) * w for k, w in enumerate((GREY_B, GREY_G, GREY_R)))
        grey = (grey + (1 << (GREY_SHIFT - 1))) >> GREY_SHIFT
    if height % size == 0 and width % size == 0:
        fy, fx = height // size, width // size
        area = fy * fx
        out = (grey.reshape(n, size, fy, size, fx).sum(axis=(2, 4)) + area // 2) // area
    else:
        out = np.rint(_area_matrix(height, size) @ grey.astype(np.float64) @ _area_matrix(width, size).T)
    return np.clip(out, 0, 255).reshape(n, -1).astype(np.float64)


def grey_resize(data: bytes, height: int, width: int, channels: int, size: int) -> list[float]:
    """One image: bytes (BGR/BGRA/grey, row-major) -> S*S grey pixels."""
    return grey_resize_many(np.frombuffer(data, dtype=np.uint8).reshape(1, height, width, channels), size)[0].tolist()


#: Bytes of images that are turned to numbers at once.
STACK_BYTES = 32 << 20


def image_pixels(spark: SparkSession, path: str, size: int = 32) -> DataFrame:
    """One row per readable image: ``(origin, px array<double>)`` with S*S grey pixels.

    ``origin`` (the file path) orders the rows like the source's sorted file
    names. Source files are never modified.
    """
    imgs = spark.read.format("image").option("dropInvalid", True).load(path)

    return imgs.select(F.col("image.origin").alias("origin"),
                       resized_pixels("image.data", "image.height", "image.width", "image.nChannels", size).alias("px"))


def resized_pixels(data, height, width, channels, size: int):
    """Grey pixels, resized to S x S, of raw image columns (bytes, height, width, channels); NULL for a NULL image."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def to_pixels(data: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
        there = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))
        out = np.zeros((len(data), size * size))
        shapes = np.stack([x.fill_null(0).to_numpy(zero_copy_only=False) for x in (h, w, c)], axis=1)[there]
        kinds, of = np.unique(shapes, axis=0, return_inverse=True)
        for k, shape in enumerate(kinds.tolist()):
            rows = there[of.reshape(-1) == k]
            step = max(1, STACK_BYTES // max(1, int(np.prod(shape))))
            for some in (rows[i:i + step] for i in range(0, len(rows), step)):
                joined = b"".join(data[int(i)].as_py() for i in some)
                out[some] = grey_resize_many(np.frombuffer(joined, np.uint8).reshape(len(some), *shape), size)
        held = np.isin(np.arange(len(data)), there)
        ends = pa.array(np.concatenate([[0], np.cumsum(held * size * size)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(out[held].reshape(-1)), mask=pa.array(~held))

    return to_pixels(data, height, width, channels)


def pixel_row_check(df: DataFrame, cells_col: str, size: int) -> DataFrame:
    """Add ``ok`` and ``reason`` for rows of text cells meant as S*S pixels.

    The length check comes first ('length'), then every stripped cell must
    parse as a float ('non-numeric'). Nothing is dropped here; filter on
    ``ok`` for the clean rows and on ``~ok`` for the report.
    """
    cells = F.col(cells_col)
    numeric = F.forall(cells, lambda c: c.isNotNull() & (c.rlike(FLOAT_RE) | c.rlike(SPECIAL_RE)))
    reason = F.when(F.size(cells) != size * size, F.lit("length")).when(~numeric, F.lit("non-numeric"))
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
