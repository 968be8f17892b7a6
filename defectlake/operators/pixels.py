"""Marks of stored images that need their pixels, in one Arrow pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import raster


def _shrink(values: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal areas, rounded."""

    def weights(n: int, cells: int) -> np.ndarray:
        edge = np.arange(cells + 1) * n / cells
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * cells / n

    return np.rint(weights(values.shape[0], rows) @ values @ weights(values.shape[1], columns).T)


def difference_hash(gray: np.ndarray, size: int = 8) -> int:
    """Whether each of size x size + 1 means of areas is below its right neighbour, first bit highest, as a signed long."""
    small = _shrink(gray, size, size + 1)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def marks(rows: DataFrame, key: str) -> DataFrame:
    """id, brightness, hash, and whether mask_size and mask_values are right, of images with `image` and `mask` bytes.

    A null or empty image has brightness 0 and no hash; a null mask counts as right. Pixels are read
    once and nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            out = []
            for k, w, h, data, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                light, code = 0.0, None
                if data and w and h:
                    image = np.frombuffer(data, np.uint8).reshape(h, w, -1)
                    light = float(image.mean())
                    code = difference_hash(raster.gray(image) if image.shape[2] == 3 else image[..., 0].astype(float))
                own = np.frombuffer(mask or b"", np.uint8)
                out.append((k, light, code, mask is None or len(own) == w * h, bool(((own == 0) | (own == 255)).all())))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "brightness", "hash", "mask_size", "mask_values"])

    from pyspark.sql import functions as F

    mask = F.col("mask") if "mask" in rows.columns else F.lit(None).cast("binary")
    return rows.select(F.col(key).cast("long"), "width", "height", "image", mask.alias("mask")).mapInArrow(run, "id long, brightness double, hash long, mask_size boolean, mask_values boolean")
