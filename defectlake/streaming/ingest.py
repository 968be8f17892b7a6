"""Streams of samples and of new seed files: the batch transforms, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.images import _measured


def seed_stream(spark: SparkSession, folder: str, suffix: str = "png") -> DataFrame:
    """New image files of a drop folder as seed rows (path, width, height, measures, image)."""
    rows = spark.readStream.format("image").schema("image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>").option("pathGlobFilter", f"*.{suffix}").load(folder)
    i = F.col("image")
    return _measured(rows.select(i["origin"].alias("path"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), i["data"].alias("data")).filter("height > 0"))


def rates(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum per time window and key; rows later than `late` after the watermark go."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    by = events.withWatermark(time, late).groupBy(window.alias("w"), key)
    return by.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
