"""Datasets on disk: COCO, YOLO and VOC layouts, metadata lines, previews and reports.

Files are written by the executors into a shared folder; the driver holds class names and single
JSON documents' lines as they stream, never pixels, but for previews of a fixed number of samples.
"""

from __future__ import annotations

import base64
import html
import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labels, raster
from .images import encode_png, write_files


def _flat(samples: DataFrame) -> DataFrame:
    """Samples with masks as arrays for the label operators, and their dense numbers."""
    bits = lambda c: F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: F.when(F.substring(F.hex(c), i * 2 + 1, F.lit(2)) == "00", 0).otherwise(255))
    return samples.withColumnRenamed("sample_idx", "id").withColumn("mask", bits(F.col("mask")))


def annotation_rows(samples: DataFrame) -> DataFrame:
    """image_id, instance, type, box and area of the stored instances: no mask is read."""
    image = labels.numbered(samples.select(F.col("sample_idx").alias("id"), "width", "height", "split", "defect_type"), "image_id", "id")
    rows = samples.select(F.col("sample_idx").alias("id"), F.posexplode("instances").alias("instance", "i"))
    return rows.select("id", "instance", F.col("i.defect_type").alias("name"), *[F.col(f"i.{k}").alias(k) for k in ("x", "y", "w", "h", "area")]).join(image, "id")


def names(samples: DataFrame) -> list[str]:
    """Category names by the first sample that has them; there are few."""
    rows = samples.select("sample_idx", F.posexplode("instances.defect_type").alias("k", "name"))
    first = rows.groupBy("name").agg(F.min(F.struct("sample_idx", "k")).alias("first"))
    return [r["name"] for r in first.orderBy("first").collect()]


def _pictures(samples: DataFrame, image: str, mask: str | None) -> DataFrame:
    rows = labels.numbered(samples.select(F.col("sample_idx").alias("id"), "split", "defect_type", "width", "height", "image", "mask"), "n", "id")
    folder = lambda t: F.replace(F.lit(t), F.lit("{split}"), F.col("split"))
    one = encode_png(rows.select(F.concat(folder(image), labels.file_name(F.col("n") - 1, F.col("defect_type"))).alias("name"), "width", "height", F.col("image").alias("data")))
    if not mask:
        return one
    return one.unionByName(encode_png(rows.select(F.concat(folder(mask), labels.file_name(F.col("n") - 1, F.col("defect_type"), "mask")).alias("name"), "width", "height", F.col("mask").alias("data")), 1))


def export_coco(samples: DataFrame, folder: str) -> dict:
    """images/, masks/, annotations.coco.json and metadata.jsonl; returns counts."""
    written = write_files(_pictures(samples, "images/", "masks/"), folder).count()
    order = names(samples)
    ids = F.create_map(*[F.lit(x) for k, n in enumerate(order, 1) for x in (n, k)]) if order else F.create_map().cast("map<string,int>")
    notes = labels.numbered(annotation_rows(samples).filter("area > 0"), "aid", "image_id", "instance")
    borders = _borders(samples)
    notes = notes.join(borders, ["id", "instance"], "left")
    flat = F.coalesce("segmentation", F.array().cast("array<array<double>>"))
    notes = notes.select("aid", F.to_json(F.struct(F.col("aid").alias("id"), "image_id", ids[F.col("name")].alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), "area", flat.alias("segmentation"), F.lit(0).alias("iscrowd"))).alias("line"))
    images = labels.images(samples.withColumnRenamed("sample_idx", "id")).select(F.col("id").alias("aid"), F.to_json(F.struct("id", "file_name", "width", "height")).alias("line"))
    os.makedirs(folder, exist_ok=True)
    counts = {}
    with open(os.path.join(folder, "annotations.coco.json"), "w") as f:  # lines stream through the driver
        f.write('{"info": {"description": "synthetic defects"}, "images": [')
        for key, rows in (("images", images), ("annotations", notes)):
            if key == "annotations":
                f.write('], "annotations": [')
            k = 0
            for k, r in enumerate(rows.orderBy("aid").toLocalIterator(), 1):  # noqa: B007
                f.write(("," if k > 1 else "") + "\n" + r["line"])
            counts[key] = k
        f.write('], "categories": ' + json.dumps([{"id": k, "name": n, "supercategory": "defect"} for k, n in enumerate(order, 1)]) + "}")
    with open(os.path.join(folder, "metadata.jsonl"), "w") as f:
        for r in labels.metadata_lines(samples.withColumnRenamed("sample_idx", "id").drop("image", "mask", "instances")).orderBy("id").toLocalIterator():
            f.write(r["line"] + "\n")
    return counts | {"categories": order, "files": written}


def _borders(samples: DataFrame) -> DataFrame:
    """id, instance and segmentation: the outer borders of each instance's mask, in one Arrow pass."""
    import numpy as np
    import pyarrow as pa

    from ..operators.contours import outer_borders

    def run(batches):
        for batch in batches:
            out = []
            for w, h, mask in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                on = np.frombuffer(mask or b"", np.uint8)
                out.append([[float(v) for v in b] for b in outer_borders(on.reshape(h, w) != 0)] if len(on) and on.any() else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["id", "instance", "segmentation"])

    rows = samples.select(F.col("sample_idx").alias("id"), "width", "height", F.posexplode("instances").alias("instance", "i"))
    return rows.select("id", "instance", "width", "height", "i.mask").mapInArrow(run, "id long, instance int, segmentation array<array<double>>")


def export_yolo(samples: DataFrame, folder: str) -> dict:
    """images/<split>/, labels/<split>/ and data.yaml; classes by name from 0."""
    order = sorted(names(samples))
    written = write_files(_pictures(samples, "images/{split}/", None), folder).count()
    ids = F.create_map(*[F.lit(x) for k, n in enumerate(order) for x in (n, k)]) if order else F.create_map().cast("map<string,int>")
    rows = annotation_rows(samples)
    part = lambda v, n: F.format_string("%.6f", F.least(F.greatest(v.cast("double") / F.col(n), F.lit(0.0)), F.lit(1.0)))
    line = F.concat_ws(" ", ids[F.col("name")].cast("string"), part(F.col("x") + F.col("w") / 2, "width"), part(F.col("y") + F.col("h") / 2, "height"), part(F.col("w"), "width"), part(F.col("h"), "height"))
    stem = F.regexp_replace(labels.file_name(F.col("image_id") - 1, F.col("defect_type")), r"\.png$", ".txt")
    grouped = rows.groupBy("image_id", "split", "defect_type").agg(F.array_sort(F.collect_list(F.when((F.col("w") > 0) & (F.col("h") > 0), F.struct("instance", line.alias("line"))))).alias("l"))
    text = F.array_join(F.transform("l", lambda r: F.concat(r["line"], F.lit("\n"))), "")
    write_files(grouped.select(F.concat(F.lit("labels/"), "split", F.lit("/"), stem).alias("name"), text.alias("data")), folder).count()
    splits = [r["split"] for r in samples.select("split").distinct().collect()]
    at = lambda s: f"images/{s if s in splits else splits[0] if splits else 'train'}"
    lines = ["path: .", f"train: {at('train')}", f"val: {at('val')}", *([f"test: {at('test')}"] if "test" in splits else []), f"nc: {len(order)}", "names:", *[f"  {k}: {json.dumps(n)}" for k, n in enumerate(order)]]
    with open(os.path.join(folder, "data.yaml"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return {"images": written, "names": order}


def export_voc(samples: DataFrame, folder: str) -> dict:
    """JPEGImages/, Annotations/ and ImageSets/Main/<split>.txt (all.txt without splits)."""
    written = write_files(_pictures(samples, "JPEGImages/", None), folder).count()
    rows = annotation_rows(samples)
    box = F.format_string(
        "<object><name>%s</name><difficult>0</difficult><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>",
        "name", F.greatest(F.lit(0), "x"), F.greatest(F.lit(0), "y"), F.least("width", F.col("x") + F.col("w")), F.least("height", F.col("y") + F.col("h")),
    )
    grouped = rows.groupBy("image_id", "split", "defect_type", "width", "height").agg(F.array_sort(F.collect_list(F.when((F.col("w") > 0) & (F.col("h") > 0), F.struct("instance", box.alias("xml"))))).alias("o"))
    name = labels.file_name(F.col("image_id") - 1, F.col("defect_type"))
    xml = F.concat(F.format_string("<annotation><filename>%s</filename><size><width>%d</width><height>%d</height><depth>3</depth></size>", name, "width", "height"), F.array_join(F.transform("o", lambda r: r["xml"]), ""), F.lit("</annotation>"))
    write_files(grouped.select(F.concat(F.lit("Annotations/"), F.regexp_replace(name, r"\.png$", ".xml")).alias("name"), xml.alias("data")), folder).count()
    os.makedirs(os.path.join(folder, "ImageSets/Main"), exist_ok=True)
    open_: dict[str, object] = {}
    for r in grouped.select("image_id", "split", F.regexp_replace(name, r"\.png$", "").alias("stem")).orderBy("image_id").toLocalIterator():
        split = r["split"] or "all"
        if split not in open_:
            open_[split] = open(os.path.join(folder, f"ImageSets/Main/{safe_name(split)}.txt"), "w")
        open_[split].write(r["stem"] + "\n")
    for f in open_.values():
        f.close()
    return {"images": written, "splits": sorted(open_)}


def safe_name(name: str) -> str:
    """A client's file name without folders or odd characters."""
    clean = re.sub(r"[^A-Za-z0-9._-]", "_", os.path.basename(name.replace("\\", "/"))).lstrip(".")
    if not clean:
        raise ValueError("an empty file name")
    return clean


def _first(samples: DataFrame, n: int) -> list:
    return samples.orderBy("sample_idx").limit(n).collect()


def _overlay(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    red = np.array([0, 0, 255], np.float32)
    return np.where(mask[..., None] > 0, raster.byte(0.5 * image + 0.5 * red), image)


def _pixels(r) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["image"], np.uint8).reshape(r["height"], r["width"], 3), np.frombuffer(r["mask"], np.uint8).reshape(r["height"], r["width"])


def contact_sheet(samples: DataFrame, path: str, most: int = 16, columns: int = 4, cell: int = 256) -> int:
    """PNG of the first samples, each above its overlay; blank if there are none."""
    rows = _first(samples, most)
    columns = max(1, min(columns, len(rows)))
    sheet = np.full((max(1, -(-len(rows) // columns)) * 2 * cell, columns * cell, 3), 255, np.uint8)
    for k, r in enumerate(rows):
        image, mask = _pixels(r)
        for j, part in enumerate((image, _overlay(image, mask))):
            y, x = (np.linspace(0, n - 1, cell).round().astype(int) for n in part.shape[:2])
            top, left = (2 * (k // columns) + j) * cell, (k % columns) * cell
            sheet[top : top + cell, left : left + cell] = part[y][:, x]
    with open(path, "wb") as f:
        f.write(raster.png(sheet))
    return len(rows)


def heatmap_image(heat: DataFrame, mean: DataFrame, width: int, height: int, path: str) -> None:
    """PNG of the mean image, tinted by hits; both tables have at most width x height rows."""
    base, hits = np.zeros((height, width), np.float32), np.zeros((height, width), np.float32)
    for r in mean.collect():
        base[r["y"], r["x"]] = r["value"]
    for r in heat.collect():
        hits[r["y"], r["x"]] = r["hits"]
    t = hits / max(1.0, hits.max())
    ramp = np.stack([np.interp(t, (0, 0.25, 0.5, 0.75, 1), c) for c in ((120, 230, 90, 30, 10), (30, 190, 240, 160, 20), (50, 40, 150, 250, 130))], -1)
    out = np.where(hits[..., None] > 0, 0.35 * base[..., None] + 0.65 * ramp, base[..., None])
    with open(path, "wb") as f:
        f.write(raster.png(raster.byte(np.broadcast_to(out, (height, width, 3)))))


def html_preview(samples: DataFrame, path: str, most: int = 64) -> int:
    """A page of up to `most` samples with a split filter and an overlay switch."""
    rows, cards = _first(samples, most), []
    url = lambda a: "data:image/png;base64," + base64.b64encode(raster.png(a)).decode()
    for r in rows:
        image, mask = _pixels(r)
        text = html.escape(f"{r['sample_idx']} · {r['defect_type']} · {r['split']} · {100 * (mask > 0).mean():.2f} %")
        cards.append(f'<figure data-split="{html.escape(r["split"])}"><img class="plain" src="{url(image)}"><img class="over" src="{url(_overlay(image, mask))}"><figcaption>{text}</figcaption></figure>')
    splits = sorted({r["split"] for r in rows})
    options = "".join(f"<option>{html.escape(s)}</option>" for s in ["all", *splits])
    page = (
        "<!doctype html><meta charset=utf-8><title>Samples</title><style>body{font:14px sans-serif}main{display:flex;flex-wrap:wrap;gap:8px}img{width:200px}"
        ".over{display:none}.o .over{display:inline}.o .plain{display:none}</style>"
        f"<header>{len(rows)} samples shown <select id=s>{options}</select> <label><input type=checkbox id=o> overlay</label></header><main>{''.join(cards)}</main>"
        "<script>s.onchange=()=>document.querySelectorAll('figure').forEach(f=>f.hidden=s.value!='all'&&f.dataset.split!=s.value);o.onchange=()=>document.body.classList.toggle('o',o.checked)</script>"
    )
    with open(path, "w") as f:
        f.write(page)
    return len(rows)


def training_scripts(folder: str) -> list[str]:
    """Small starting points for training on an exported dataset."""
    scripts = {
        "train_yolo.py": "from ultralytics import YOLO\n\nYOLO('yolov8n.pt').train(data='data.yaml', epochs=50, imgsz=256)\n",
        "read_parquet.py": "from pyspark.sql import SparkSession\n\nspark = SparkSession.builder.getOrCreate()\nspark.read.parquet('samples').filter(\"split = 'train'\").select('image', 'mask').show()\n",
    }
    os.makedirs(folder, exist_ok=True)
    for name, text in scripts.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return sorted(scripts)
