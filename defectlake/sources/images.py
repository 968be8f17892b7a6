"""Image folders, metadata and COCO files as tables; procedural surfaces; PNG sinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import raster

SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff", "tif")
SEEDS = "id long, path string, width int, height int, channels int, mean_brightness double, blur_score double, image binary"


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, channels and BGR data of a folder's images; undecodable ones have height -1.

    Only files directly in the folder, with a known suffix in any case, are decoded: the suffix
    filter is on the path, which the listing already knows.
    """
    pattern = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in SUFFIXES) + "}"
    rows = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _measured(rows: DataFrame) -> DataFrame:
    """Three channels whatever the file had, with brightness and blur, in one Arrow pass per image."""

    def run(batches):
        for batch in batches:
            out = []
            for path, w, h, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                px = np.repeat(px, 3, 2) if n == 1 else px[..., :3]
                g = np.pad(raster.gray(px), 1, mode="reflect" if min(h, w) > 1 else "edge")
                lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
                out.append((path, w, h, 3, float(px.mean()), float(lap.var(dtype=np.float64)), px.tobytes()))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["path", "width", "height", "channels", "mean_brightness", "blur_score", "image"])

    return rows.mapInArrow(run, SEEDS.split(", ", 1)[1])


def load_seeds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Seeds numbered from 0 by path, and a warning per file that cannot be decoded.

    A missing folder or one without image files is an error. Numbers come from paths alone: pixels
    do not pass through the sort.
    """
    rows = scan(spark, folder)
    if rows.select("path").limit(1).count() == 0:
        raise ValueError(f"no images in {folder}")
    good = rows.filter("height > 0 and width > 0")
    ids = good.select("path").select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("id"))
    seeds = _measured(good).join(ids, "path").select(*[c.split()[0] for c in SEEDS.split(", ")])
    bad = rows.filter("height <= 0 or width <= 0").select("path", F.lit("corrupt").alias("code"), F.lit("cannot be decoded").alias("message"), F.lit("error").alias("severity"))
    return seeds, bad


def labelled_pairs(spark: SparkSession, images: str, masks: str) -> DataFrame:
    """Images with their masks and label (1 if any mask pixel is set); pairs that both decode.

    A mask has its image's name, or that name with mask_ in place of image_; the former goes first.
    """
    a = scan(spark, images).filter("height > 0").withColumn("name", base_name(F.col("path")))
    b = scan(spark, masks).filter("height > 0").select(base_name(F.col("path")).alias("mask_name"), F.col("data").alias("mask"), F.col("channels").alias("mask_channels"))
    asks = F.array(F.struct(F.lit(0).alias("rank"), F.col("name").alias("ask")), F.struct(F.lit(1).alias("rank"), F.regexp_replace("name", "image_", "mask_").alias("ask")))
    names = a.select("name", F.inline(asks)).join(b.select("mask_name"), F.col("ask") == F.col("mask_name"))
    best = names.groupBy("name").agg(F.min_by("mask_name", "rank").alias("mask_name"))
    joined = a.join(best, "name").join(b, "mask_name")
    label = F.regexp_replace(F.hex("mask"), "0", "") != ""
    return joined.select("name", "path", "width", "height", "channels", F.col("data").alias("image"), "mask", "mask_channels", label.cast("int").alias("label"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Lines of metadata.jsonl by image; the last line of an image counts; broken lines are skipped."""
    schema = "image string, source_seed string, defect_type string, random_seed long, split string, metadata map<string,string>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.filter("_bad is null and image is not null").withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    last = F.max_by(F.struct("source_seed", F.coalesce("defect_type", F.lit("unknown")).alias("defect_type"), F.coalesce("random_seed", F.lit(0)).alias("random_seed"), F.coalesce("split", F.lit("train")).alias("split")), "_at")
    return rows.groupBy("image").agg(last.alias("m")).select("image", "m.*")


def read_coco(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of COCO files, each with run_idx from 1 by its place in `paths`."""
    schema = (
        "images array<struct<id:long,file_name:string,width:int,height:int>>, "
        "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,segmentation:array<array<double>>,iscrowd:int>>, "
        "categories array<struct<id:long,name:string,supercategory:string>>"
    )
    runs = [spark.read.schema(schema).option("multiLine", True).json(p).withColumn("run_idx", F.lit(k)) for k, p in enumerate(paths, 1)]
    if not runs:
        raise ValueError("no datasets to merge")
    whole = runs[0]
    for r in runs[1:]:
        whole = whole.unionByName(r)
    return tuple(whole.select("run_idx", F.inline(c)) for c in ("images", "annotations", "categories"))


SURFACES = ("brushed_metal", "ceramic", "woven_fabric", "smooth_plastic", "matte_polymer")


def surface(kind: str, size: int, seed: int) -> np.ndarray:
    """A clean procedural surface."""
    rng = np.random.default_rng([seed, SURFACES.index(kind)])
    yy, xx = np.mgrid[0:size, 0:size].astype(np.float32)
    if kind == "brushed_metal":
        base = 150 + raster.blur(np.repeat(rng.normal(0, 14, (size, 1)), size, 1), 0.6) + rng.normal(0, 4, (size, size))
        tint = [1.0, 0.99, 0.97]
    elif kind == "ceramic":
        base = 205 + 8 * np.sin(xx / 23) * np.cos(yy / 31) + rng.normal(0, 2.5, (size, size))
        tint = [0.97, 1.0, 1.02]
    elif kind == "woven_fabric":
        base = 120 + 22 * np.sin(xx * 0.9) + 22 * np.sin(yy * 0.9) + rng.normal(0, 6, (size, size))
        tint = [1.1, 0.95, 0.9]
    elif kind == "smooth_plastic":
        base = 170 + 18 * (xx + yy) / (2 * size) + rng.normal(0, 1.5, (size, size))
        tint = [0.95, 1.0, 0.9]
    else:
        base = 90 + raster.enlarge(rng.uniform(-10, 10, (10, 10)), size, size) + rng.normal(0, 5, (size, size))
        tint = [1.0, 1.0, 1.0]
    return raster.byte(base[..., None] * np.array(tint))


def surfaces(spark: SparkSession, n: int, size: int = 256, seed: int = 0) -> DataFrame:
    """n clean seeds, of the kinds in turn, made in parallel."""

    def run(batches):
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                kind = SURFACES[k % len(SURFACES)]
                rows.append((k, f"{kind}_{k:03d}.png", size, size, surface(kind, size, seed + k).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()], strict=True)] if rows else [], ["id", "path", "width", "height", "image"] if rows else [])

    return spark.range(n).mapInArrow(run, "id long, path string, width int, height int, image binary")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (name, data) rows as files under `folder`, from the executors; returns name and bytes.

    Each file is written under another name and renamed, so a task that runs again or twice leaves
    whole files only. `folder` must be one that all executors share.
    """

    def run(batches):
        import os
        import uuid

        for batch in batches:
            sizes = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return rows.select("name", F.col("data").cast("binary").alias("data")).mapInArrow(run, "name string, bytes long")


def encode_png(rows: DataFrame, channels: int = 3) -> DataFrame:
    """name and PNG data of (name, width, height, data) rows."""

    def run(batches):
        for batch in batches:
            out = []
            for w, h, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                px = np.frombuffer(data, np.uint8)
                out.append(raster.png(px.reshape(h, w, 3) if channels == 3 else px.reshape(h, w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["name", "data"])

    return rows.select("name", "width", "height", "data").mapInArrow(run, "name string, data binary")
