"""Adaptors that read the star-schema tables as seeds, images, masks, samples and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clip, squares, total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of 64 values as gray images of 8 by 8."""
    px = F.transform("embedding", lambda e: F.floor(clip((e.cast("double") + 0.5) * 255, 0.0, 255.0)).cast("int"))
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), px.alias("px"), F.coalesce("label", F.lit(-1)).alias("label"))


def masks8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with the mask (0 or 255) of pixels above mean plus deviation, decided in integers."""
    images = images8(spark, sf_dir).withColumn("s", total(F.col("px"))).withColumn("q", squares(F.col("px")))

    def above(v):
        gap = v * 64 - F.col("s")
        return F.when((gap > 0) & (gap * gap > F.col("q") * 64 - F.col("s") * F.col("s")), 255).otherwise(0)

    return images.withColumn("mask", F.transform("px", above)).drop("s", "q")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples: the text's digest is the seed, source the split, language the type."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.md5(F.col("text").cast("binary")).alias("source_seed"),
        F.col("source").alias("split"),
        F.col("lang").alias("defect_type"),
        (F.coalesce(F.col("n_chars"), F.lit(0)) / 100.0).alias("area_percent"),
        F.col("n_chars").cast("double").alias("brightness"),
        F.coalesce(F.col("quality"), F.lit(0)).alias("annotations"),
    )


def points64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hits on a canvas of 64 by 64."""
    return table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(64)).cast("int").alias("y"), F.pmod("l_partkey", F.lit(64)).cast("int").alias("x"))


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as the images, and their line items as the annotations, of one run per priority."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    run = F.substring("o_orderpriority", 1, 1).cast("int")
    images = orders.select(run.alias("run_idx"), F.col("o_orderkey").alias("id"), F.format_string("image_%07d.png", "o_orderkey").alias("file_name"), "o_orderstatus")
    by = images.groupBy("run_idx", F.col("o_orderstatus").alias("name")).agg(F.min("id").alias("first"))
    from pyspark.sql import Window

    categories = by.select("run_idx", F.row_number().over(Window.partitionBy("run_idx").orderBy("first", "name")).alias("id"), "name")
    owners = images.join(categories.select("run_idx", F.col("id").alias("category_id"), F.col("name").alias("o_orderstatus")), ["run_idx", "o_orderstatus"])
    annotations = items.join(owners.select("run_idx", F.col("id").alias("image_id"), "category_id"), items["l_orderkey"] == F.col("image_id"))
    annotations = annotations.select("run_idx", "image_id", "category_id", (F.col("image_id") * 8 + F.col("l_linenumber")).alias("id"))
    return images.drop("o_orderstatus"), annotations, categories
