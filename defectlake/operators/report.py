"""Statistics, validation, leakage and model-evaluation aggregates over sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio


def statistics(samples: DataFrame) -> DataFrame:
    """One row over `samples` (area_percent, brightness, annotations): counts, extremes, means, median.

    Zeros for an empty table. Annotations are counted, not images.
    """
    some = F.col("area_percent") > 0
    zero = F.lit(0.0)
    n = F.count("*")
    return samples.agg(
        n.alias("total_images"),
        F.coalesce(F.sum("annotations"), F.lit(0)).cast("long").alias("total_annotations"),
        F.coalesce(F.min("area_percent"), zero).alias("min_area_percent"),
        F.coalesce(F.max("area_percent"), zero).alias("max_area_percent"),
        F.coalesce(F.avg("area_percent"), zero).alias("mean_area_percent"),
        F.coalesce(F.median("area_percent"), zero).alias("median_area_percent"),
        F.count_if(~some).alias("empty_masks"),
        (ratio(F.count_if(some), n) * 100).alias("success_rate"),
        F.coalesce(F.min("brightness"), zero).alias("min_brightness"),
        F.coalesce(F.max("brightness"), zero).alias("max_brightness"),
        F.coalesce(F.avg("brightness"), zero).alias("mean_brightness"),
    )


def counts_by(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count("*").alias("n"))


def split_statistics(samples: DataFrame) -> DataFrame:
    """Per split: images, mean area and brightness, and the counts of its defect types as a map."""
    types = samples.groupBy("split", "defect_type").agg(F.count("*").alias("n"), F.sum("area_percent").alias("area"), F.sum("brightness").alias("light"))
    return types.groupBy("split").agg(
        F.sum("n").alias("images"),
        (F.sum("area") / F.sum("n")).alias("mean_area_percent"),
        (F.sum("light") / F.sum("n")).alias("mean_brightness"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("defect_type", "n")))).alias("defects"),
    )


def split_balance(samples: DataFrame, least: float = 0.1) -> DataFrame:
    """One row: splits present, rows in all, and whether none holds less than `least` of them."""
    by = samples.groupBy("split").agg(F.count("*").alias("n"))
    whole = by.agg(F.count("*").alias("splits"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("n").alias("fewest"))
    return whole.select("splits", "total", (ratio(F.col("fewest"), F.col("total")) >= least).alias("is_balanced"))


def validation(samples: DataFrame) -> DataFrame:
    """code and count of each validation code in `codes`, and of the rows without any (`valid`)."""
    codes = F.when(F.size("codes") == 0, F.array(F.lit("valid"))).otherwise(F.col("codes"))
    return samples.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def issues(samples: DataFrame) -> DataFrame:
    return samples.filter(F.size("codes") > 0).select("id", F.concat_ws("; ", "codes").alias("details"))


def leakage(samples: DataFrame) -> DataFrame:
    """Seeds used in more than one split, with the splits in order.

    Distinct pairs come first, so a seed's group holds one row per split.
    """
    pairs = samples.select("source_seed", "split").filter("source_seed is not null and split is not null").distinct()
    by = pairs.groupBy("source_seed").agg(F.sort_array(F.collect_list("split")).alias("splits"))
    return by.filter(F.size("splits") > 1)


def seeds_per_split(samples: DataFrame) -> DataFrame:
    """Per split the samples and the distinct seeds."""
    by = samples.groupBy("split", "source_seed").agg(F.count("*").alias("n"))
    return by.groupBy("split").agg(F.sum("n").alias("samples"), F.count("source_seed").alias("seeds"))


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: the four counts with accuracy, precision, recall and F1; zeros where undefined."""
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    c = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
