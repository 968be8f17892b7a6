"""Annotation tables of a dataset: COCO, YOLO and VOC rows from samples and their masks.

Samples have id, defect_type, width, height and mask; a compound sample's `instances`, an array of
struct<defect_type, mask>, each give an annotation of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import positions
from .fusion import dense_ids
from .measures import area, bbox, yolo_box


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Dense numbers from 1 in the order of `order`, whose first column is a whole number."""
    return dense_ids(rows, name, *order, ranged=order[0])


def file_name(index: Column, kind: Column, prefix: str = "image") -> Column:
    return F.format_string(prefix + "_%04d_%s.png", index, kind)


def images(samples: DataFrame) -> DataFrame:
    rows = numbered(samples.select("id", "defect_type", "width", "height"), "image_id", "id")
    return rows.select(F.col("image_id").alias("id"), file_name(F.col("image_id") - 1, F.col("defect_type")).alias("file_name"), "width", "height")


def categories(samples: DataFrame) -> DataFrame:
    """id and name of the types in the order of their first sample; one row per type is numbered."""
    first = samples.groupBy(F.col("defect_type").alias("name")).agg(F.min("id").alias("first"))
    return first.select(F.row_number().over(Window.orderBy("first", "name")).alias("id"), "name")


def classes(samples: DataFrame) -> DataFrame:
    """class_id from 0 and name, by name."""
    names = samples.select(F.col("defect_type").alias("name")).distinct()
    return names.select((F.row_number().over(Window.orderBy("name")) - 1).alias("class_id"), "name")


def instances(samples: DataFrame) -> DataFrame:
    """One row per instance with its box and area; samples without instances are their own."""
    own = F.array(F.struct("defect_type", "mask"))
    some = F.when(F.size("instances") > 0, F.col("instances")).otherwise(own) if "instances" in samples.columns else own
    rows = samples.select("id", "width", "height", F.posexplode(some).alias("instance", "i"))
    rows = rows.select("id", "width", "height", "instance", F.col("i.defect_type").alias("defect_type"), F.col("i.mask").alias("mask"))
    return rows.withColumn("box", bbox(F.col("mask"), F.col("width"))).withColumn("area", area(F.col("mask")))


def annotations(samples: DataFrame) -> DataFrame:
    """COCO annotations of all instances with a positive area, numbered by (sample, instance)."""
    image = numbered(samples.select("id"), "image_id", "id")
    rows = instances(samples).filter("area > 0").join(image, "id")
    rows = rows.join(F.broadcast(categories(samples).select(F.col("id").alias("category_id"), F.col("name").alias("defect_type"))), "defect_type")
    rows = numbered(rows, "annotation_id", "image_id", "instance")
    return rows.select(F.col("annotation_id").alias("id"), "image_id", "category_id", F.col("box.x").alias("x"), F.col("box.y").alias("y"), F.col("box.w").alias("w"), F.col("box.h").alias("h"), "area", F.lit(0).alias("iscrowd"))


def yolo_lines(samples: DataFrame) -> DataFrame:
    """id and label line `class xc yc w h` of each instance with a box."""
    rows = instances(samples).filter("box.w > 0 and box.h > 0")
    rows = rows.join(F.broadcast(classes(samples).withColumnRenamed("name", "defect_type")), "defect_type")
    box = yolo_box(F.col("box"), F.col("width"), F.col("height"))
    return rows.select("id", "instance", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", box["xc"], box["yc"], box["bw"], box["bh"]).alias("line"))


def voc_boxes(samples: DataFrame) -> DataFrame:
    rows = instances(samples).filter("box.w > 0 and box.h > 0")
    x, y = F.col("box.x"), F.col("box.y")
    return rows.select(
        "id",
        "instance",
        F.col("defect_type").alias("name"),
        F.greatest(F.lit(0), x).alias("xmin"),
        F.greatest(F.lit(0), y).alias("ymin"),
        F.least("width", x + F.col("box.w")).alias("xmax"),
        F.least("height", y + F.col("box.h")).alias("ymax"),
    )


def voc_xml(samples: DataFrame) -> DataFrame:
    """id and the annotation file of each sample; its boxes are few."""
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c.cast("string"), F.lit(f"</{n}>"))
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    box = F.concat(F.lit("<bndbox>"), *[tag(k, F.col(k)) for k in ("xmin", "ymin", "xmax", "ymax")], F.lit("</bndbox>"))
    objects = voc_boxes(samples).select("id", F.struct("instance", F.concat(F.lit("<object>"), tag("name", escape(F.col("name"))), F.lit("<difficult>0</difficult>"), box, F.lit("</object>")).alias("xml")).alias("o"))
    by = objects.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["xml"]), "").alias("objects"))
    image = numbered(samples.select("id", "defect_type", "width", "height"), "n", "id").join(by, "id", "left")
    size = F.concat(F.lit("<size>"), tag("width", F.col("width")), tag("height", F.col("height")), F.lit("<depth>3</depth></size>"))
    name = escape(file_name(F.col("n") - 1, F.col("defect_type")))
    return image.select("id", F.concat(F.lit("<annotation>"), tag("filename", name), size, F.coalesce("objects", F.lit("")), F.lit("</annotation>")).alias("xml"))


def polygons(masks: DataFrame) -> DataFrame:
    """id and the outer borders of the mask's parts, each a flat list x1, y1, x2, y2, ...

    Borders are followed in Arrow batches: a step depends on the step before, which no built-in
    function expresses. Straight runs keep their ends only; borders of under three corners go.
    """
    import pyarrow as pa

    from .contours import outer_borders

    def run(batches):
        import numpy as np

        for batch in batches:
            out = []
            for w, h, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out.append(outer_borders(np.array(m or [], np.int64).reshape(h or 0, w or 0) != 0) if m else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["id", "polygons"])

    return masks.select("id", "width", "height", "mask").mapInArrow(run, "id long, polygons array<array<double>>")


def metadata_lines(samples: DataFrame) -> DataFrame:
    """One JSON line per sample, its `metadata` map laid over the fixed fields."""
    rows = numbered(samples, "n", "id")
    name = file_name(F.col("n") - 1, F.col("defect_type"))
    fixed = {"image": name, "source_seed": F.col("source_seed"), "defect_type": F.col("defect_type"), "random_seed": F.col("random_seed").cast("string"), "split": F.coalesce("split", F.lit("train"))}
    base = F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*fixed.values()))
    over = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    whole = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
    return rows.select("id", F.to_json(whole).alias("line"))


__all__ = ["annotations", "categories", "classes", "file_name", "images", "instances", "metadata_lines", "numbered", "polygons", "positions", "voc_boxes", "voc_xml", "yolo_lines"]
