"""Features of an image and its mask, and how widely they spread over a dataset.

Features read neighbourhoods of pixels, for which array functions would be interpreted cell by cell;
one Arrow pass with NumPy is tens of times faster, and holds one image at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = ["area_ratio", "aspect_ratio", "grad_mag_boundary", "contrast"]


def names(channels: list[str]) -> list[str]:
    return [f"{part}_{c}_{m}" for c in channels for part in ("defect", "background") for m in ("mean", "std")] + SHAPE


def gradient(gray: np.ndarray) -> np.ndarray:
    """Sobel magnitude, borders mirrored."""
    p = np.pad(gray.astype(float), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    columns = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return np.hypot(rows[:, 2:] - rows[:, :-2], columns[2:] - columns[:-2])


def boundary(mask: np.ndarray) -> np.ndarray:
    """Where the mask differs within 3 by 3, cut at the image's edge."""
    p = np.pad(mask, 1, mode="edge")
    parts = [p[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(3) for x in range(3)]
    return np.logical_or.reduce(parts) & ~np.logical_and.reduce(parts)


def of_image(channels: list[np.ndarray], mask: np.ndarray) -> list[float]:
    """The features in the order of `names`; zeros for regions without pixels."""
    h, w = mask.shape
    out, inside, outside = [], [], []
    for px in channels:
        for part, means in ((px[mask], inside), (px[~mask], outside)):
            m, s = (float(part.mean()), float(part.std())) if part.size else (0.0, 0.0)
            out += [m, s]
            means.append(m)
    gray = np.rint(0.114 * channels[0] + 0.587 * channels[1] + 0.299 * channels[2]) if len(channels) == 3 else channels[0]
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    aspect = (columns[-1] - columns[0] + 1) / (rows[-1] - rows[0] + 1) if len(rows) else 0.0
    edge = boundary(mask)
    steep = float(gradient(gray)[edge].mean()) if edge.any() else 0.0
    some = mask.any() and not mask.all()
    return [*out, float(mask.mean()), float(aspect), steep, abs(float(np.mean(inside)) - float(np.mean(outside))) if some else 0.0]


def extract(images: DataFrame, channels: dict[str, str] | None = None) -> DataFrame:
    """id and the features: mean and deviation of each channel inside and outside of the mask,
    area ratio, box aspect, mean gradient on the mask's boundary, and contrast between the two.

    `channels` maps feature names to columns of pixel arrays, three in the order blue, green, red;
    gray images have the one `px`. Images whose arrays are null or of another size give zeros.
    """
    channels = channels or {"gray": "px"}
    columns = names(list(channels))

    def run(batches):
        for batch in batches:
            lists = [(batch.column(k).values.to_numpy(zero_copy_only=False), batch.column(k).offsets.to_numpy(), batch.column(k).is_null().to_numpy(zero_copy_only=False)) for k in range(3, batch.num_columns)]
            rows = np.zeros((batch.num_rows, len(columns)))
            for i, (w, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                parts = [v[o[i] : o[i + 1]] for v, o, null in lists if not null[i]]
                if w and h and len(parts) == len(lists) and all(len(p) == w * h for p in parts):
                    mask, *px = (p.reshape(h, w) for p in parts)
                    rows[i] = of_image(px, mask != 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, k]) for k in range(len(columns))]], ["id", *columns])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "width", "height", "mask", *channels.values()).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in columns))


def diversity(features: DataFrame) -> DataFrame:
    """One row: the mean over features of their population deviation."""
    own = [c for c in features.columns if c not in ("id", "label")]
    some = features.agg(*[F.stddev_pop(c).alias(c) for c in own])
    return some.select((sum((F.col(c) for c in own), F.lit(0.0)) / len(own)).alias("feature_diversity"))


def intra_class_variance(features: DataFrame) -> DataFrame:
    """One row: the mean over classes of more than one row of the mean population variance."""
    own = [c for c in features.columns if c not in ("id", "label")]
    by = features.groupBy("label").agg(F.count("*").alias("n"), *[F.var_pop(c).alias(c) for c in own]).filter("n > 1")
    return by.agg(F.coalesce(F.avg(sum((F.col(c) for c in own), F.lit(0.0)) / len(own)), F.lit(0.0)).alias("intra_class_variance"))
