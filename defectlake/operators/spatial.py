"""Where defects lie: hits per position, coverage, centroid and entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, half_even, positions, ratio


def heat(points: DataFrame) -> DataFrame:
    """y, x and hits; partial counts are combined before the shuffle, so a hot position is one row."""
    return points.groupBy("y", "x").agg(F.count("*").alias("hits"))


def mask_points(masks: DataFrame, width: int, height: int) -> DataFrame:
    """Mask positions on a canvas of `width` by `height`, to which other sizes are scaled (nearest)."""
    w, h = F.col("width"), F.col("height")
    at = masks.select("width", "height", F.explode(positions(F.col("mask"))).alias("i"))
    x, y = F.col("i") % w, (F.col("i") / w).cast("int")
    return at.select(F.floor(y * F.lit(height) / h).cast("int").alias("y"), F.floor(x * F.lit(width) / w).cast("int").alias("x"))


def mean_image(images: DataFrame) -> DataFrame:
    """y, x and the mean value, of images of one size."""
    at = images.select("width", F.posexplode("px").alias("i", "v"))
    return at.groupBy((F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x")).agg(F.avg("v").alias("value"))


def metrics(heated: DataFrame, width: int, height: int, cells: int = 8) -> DataFrame:
    """One row: coverage, centroid (0..1, a half if empty) and entropy over cells (0..1).

    A cell is max(1, size // cells) wide; positions beyond the last whole cell count for all but the
    entropy. The heat table has at most width x height rows.
    """
    cw, ch = max(1, width // cells), max(1, height // cells)
    some = heated.filter("hits > 0")
    whole = some.agg(F.count("*").alias("n"), F.sum("hits").alias("s"), F.sum(F.col("x") * F.col("hits")).alias("sx"), F.sum(F.col("y") * F.col("hits")).alias("sy"))
    cx, cy = (F.col("x") / cw).cast("int"), (F.col("y") / ch).cast("int")
    by = some.filter((cx < cells) & (cy < cells)).groupBy(cy.alias("cy"), cx.alias("cx")).agg(F.sum("hits").alias("c"))
    # entropy of shares p = c / C: log2(C) - sum(c log2 c) / C
    bits = by.agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("e"))
    entropy = F.coalesce((F.log2(F.col("k").cast("double")) - F.col("e") / F.col("k")) / F.log2(F.lit(float(cells * cells))), F.lit(0.0))
    middle = F.lit(0.5)
    return whole.join(bits, how="cross").select(
        half_even(F.col("n") / F.lit(float(width * height)), 4).alias("coverage"),
        half_even(F.when(F.col("n") > 0, ratio(F.col("sx"), F.col("s") * width)).otherwise(middle), 4).alias("centroid_x"),
        half_even(F.when(F.col("n") > 0, ratio(F.col("sy"), F.col("s") * height)).otherwise(middle), 4).alias("centroid_y"),
        half_even(clip(entropy, 0.0, 1.0), 4).alias("entropy"),
    )
