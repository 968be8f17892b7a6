"""Merging runs: images, annotations and categories of many datasets under new ids.

Inputs carry `run_idx`. New ids are dense and follow (run_idx, id); they come from counts per range
of the sorted keys, so that no task numbers the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANGE = 65536


def dense_ids(rows: DataFrame, name: str, *order: str, ranged: str, runs: str | None = None) -> DataFrame:
    """Numbers rows from 1 in `order`.

    The order begins with `runs`, if given, and then the whole number `ranged`. Rows are ranked
    within ranges of RANGE values of it, in parallel and whatever a run's size, and shifted by the
    counts of all ranges before: a table that is smaller by the rows of a range.
    """
    keys = [*([runs] if runs else []), "_range"]
    rows = rows.withColumn("_range", F.expr(f"{ranged} div {RANGE}"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(*keys, before.alias("_before"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", number).join(shift, keys).withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_before", "_range")


def merge_images(images: DataFrame, name: Column | None = None) -> DataFrame:
    """run_idx, old_id, id and file_name with the prefix of its run."""
    numbered = dense_ids(images, "new_id", "run_idx", "id", ranged="id", runs="run_idx")
    prefix = F.concat(F.lit("run"), F.col("run_idx").cast("string"), F.lit("_"))
    return numbered.select("run_idx", F.col("id").alias("old_id"), F.col("new_id").alias("id"), F.concat(prefix, name if name is not None else F.col("file_name")).alias("file_name"))


def merge_categories(categories: DataFrame) -> DataFrame:
    """id and name, ids from 1 by the first (run_idx, id) that has the name.

    One row per name remains before the numbering, so one task sorts category names only.
    """
    first = categories.groupBy("name").agg(F.min(F.struct("run_idx", "id")).alias("first"))
    return first.select(F.row_number().over(Window.orderBy("first", "name")).alias("id"), "name")


def merge_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame, merged: DataFrame) -> DataFrame:
    """Annotations with new ids, image ids and category ids.

    Annotations of unknown images go; an unknown category becomes 1. `images` is the result of
    merge_images, `categories` the old table with run_idx, `merged` that of merge_categories.
    """
    names = categories.select("run_idx", F.col("id").alias("category_id"), "name").join(merged.select(F.col("id").alias("new_category"), "name"), "name").drop("name")
    kept = annotations.join(images.select("run_idx", F.col("old_id").alias("image_id"), F.col("id").alias("new_image")), ["run_idx", "image_id"])
    kept = kept.join(names, ["run_idx", "category_id"], "left")
    kept = dense_ids(kept, "new_id", "run_idx", "id", ranged="id", runs="run_idx")
    return kept.select("run_idx", F.col("new_id").alias("id"), F.col("new_image").alias("image_id"), F.coalesce("new_category", F.lit(1)).alias("category_id"))


def merge_summary(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    runs = images.agg(F.countDistinct("run_idx").alias("runs"), F.count("*").alias("images"))
    names = categories.agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("categories"))
    return runs.join(annotations.agg(F.count("*").alias("annotations")), how="cross").join(names, how="cross")


def rename_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata lines under their images' new names, by run."""
    return metadata.withColumn("image", F.concat(F.lit("run"), F.col("run_idx").cast("string"), F.lit("_"), F.col("image")))
