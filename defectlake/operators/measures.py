"""Measures of one image: projections over a row's pixel array, so nothing is shuffled.

An image row has `id`, `width`, `height` and `px`, its gray or interleaved channel values in row
order; a mask row has `mask` of the same order, non-zero inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import at, clip, mean, positions, ratio, spread, squares, total


def brightness(px: Column) -> Column:
    """Mean over all pixels and channels."""
    return mean(px)


def contrast(px: Column) -> Column:
    """Population standard deviation of all values."""
    return spread(px)


def _mirror(k: Column, n: Column) -> Column:
    """Index k in 0..n-1 with borders mirrored about the edge pixel."""
    inside = F.abs(k)
    return F.when(n == 1, F.lit(0)).when(inside > n - 1, 2 * (n - 1) - inside).otherwise(inside)


def _neighbour(px: Column, i: Column, width: Column, height: Column, dx: int, dy: int) -> Column:
    x, y = i % width, (i / width).cast("int")
    return at(px, _mirror(y + dy, height) * width + _mirror(x + dx, width))


def laplacian(px: Column, width: Column, height: Column) -> Column:
    """The four-neighbour Laplacian of a gray image, as an array."""

    def one(v: Column, i: Column) -> Column:
        around = [_neighbour(px, i, width, height, dx, dy) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        return (around[0] + around[1] + around[2] + around[3] - 4 * v).cast("long")

    return F.transform(px, one)


def blur_score(images: DataFrame) -> DataFrame:
    """id and the population variance of the Laplacian."""
    lap = images.select("id", laplacian(F.col("px"), F.col("width"), F.col("height")).alias("l"))
    n, s = F.size("l").cast("long"), total(F.col("l"))
    return lap.select("id", ratio(n * squares(F.col("l")) - s * s, n * n).alias("blur_score"))


def area(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda v: v != 0))


def bbox(mask: Column, width: Column) -> Column:
    """x, y, w, h of the non-zero elements; zeros if there are none."""
    on = positions(mask)
    xs, ys = F.transform(on, lambda i: i % width), F.transform(on, lambda i: (i / width).cast("int"))
    x, y = F.array_min(xs), F.array_min(ys)
    zero = F.lit(0)
    return F.struct(
        F.coalesce(x, zero).alias("x"),
        F.coalesce(y, zero).alias("y"),
        F.coalesce(F.array_max(xs) - x + 1, zero).alias("w"),
        F.coalesce(F.array_max(ys) - y + 1, zero).alias("h"),
    )


def yolo_box(box: Column, width: Column, height: Column) -> Column:
    """Centre and size over the image's, clipped to 0..1; zeros for empty boxes and images."""

    def part(value: Column, whole: Column) -> Column:
        return clip(ratio(value, whole), 0.0, 1.0)

    some = (box["w"] > 0) & (box["h"] > 0) & (width > 0) & (height > 0)
    fields = {"xc": (box["x"] + box["w"] / 2, width), "yc": (box["y"] + box["h"] / 2, height), "bw": (box["w"], width), "bh": (box["h"], height)}
    return F.struct(*[F.when(some, part(v, n)).otherwise(0.0).alias(k) for k, (v, n) in fields.items()])


def area_percent(area_: Column, width: Column, height: Column) -> Column:
    return ratio(area_, width * height) * 100


def dhash(px: Column, width: int, height: int, size: int = 8) -> Column:
    """Difference hash of a gray image: rows by columns of growing brightness, first bit highest.

    The image is averaged by area to size+1 columns and size rows, with values rounded; an image
    that is no larger than that grid is compared as it is.
    """
    columns, rows = min(size + 1, width), min(size, height)

    def weights(cells: int, n: int, k: int) -> list[tuple[int, float]]:
        low, high = k * n / cells, (k + 1) * n / cells
        return [(i, min(high, i + 1) - max(low, i)) for i in range(int(low), n) if min(high, i + 1) > max(low, i)]

    def cell(y: int, x: int) -> Column:
        if (columns, rows) == (width, height):
            return F.get(px, F.lit(y * width + x))
        parts = [F.get(px, F.lit(j * width + i)) * F.lit(a * b) for j, a in weights(rows, height, y) for i, b in weights(columns, width, x)]
        return F.round(sum(parts[1:], parts[0]) / F.lit(width * height / (columns * rows)))

    bits = rows * (columns - 1)
    grid = [[cell(y, x) for x in range(columns)] for y in range(rows)]
    out = F.lit(0).cast("long")
    for y in range(rows):
        for x in range(columns - 1):
            k = bits - 1 - (y * (columns - 1) + x)
            value = (1 << k) - (1 << 64 if k == 63 else 0)
            out = out.bitwiseOR(F.when(grid[y][x + 1] > grid[y][x], F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def validity(mask_values: Column, mask_size: Column, pixels: Column, area_: Column, box: Column) -> Column:
    """Codes of what is wrong with a sample's mask, in order; an empty array if nothing is."""
    shape = mask_size != pixels
    invalid = F.exists(mask_values, lambda v: ~v.isin(0, 255))
    empty = area_ == 0
    bad_box = ~empty & ((box["w"] <= 0) | (box["h"] <= 0))
    return F.array_compact(F.array(F.when(shape, "shape_mismatch"), F.when(invalid, "invalid_mask"), F.when(empty, "empty_mask"), F.when(bad_box, "invalid_bbox")))
