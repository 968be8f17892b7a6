"""Quality of a synthetic dataset: feature spread, probe, baselines, and the packaged benchmark."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from . import features, probe
from .synthesis import generate

NAMES = features.names(["blue", "green", "red"])


def sample_features(samples: DataFrame, key: str = "sample_idx") -> DataFrame:
    """id, label (1 if any mask pixel is set) and the sixteen features of stored images and masks."""

    def run(batches):
        for batch in batches:
            ids, labels, rows = batch.column(0), [], np.zeros((batch.num_rows, len(NAMES)))
            for i, (w, h, image, mask) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                px, m = np.frombuffer(image, np.uint8).reshape(h, w, -1), np.frombuffer(mask, np.uint8).reshape(h, w, -1)[..., 0] > 0
                px = np.repeat(px, 3, 2) if px.shape[2] == 1 else px
                rows[i] = features.of_image([px[..., k].astype(float) for k in range(3)], m)
                labels.append(int(m.any()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(labels, pa.int32()), *[pa.array(rows[:, k]) for k in range(len(NAMES))]], ["id", "label", *NAMES])

    rows = samples.select(F.col(key).cast("long"), "width", "height", "image", "mask")
    return rows.mapInArrow(run, "id long, label int, " + ", ".join(f"{c} double" for c in NAMES))


def evaluate(samples: DataFrame, real: DataFrame | None = None, trees: int = probe.TREES) -> dict:
    """Diversity, variance within classes, and, with labelled real images, probe and baselines.

    `real` has name, width, height, image and mask, as `labelled_pairs` gives them.
    """
    own = sample_features(samples).cache()
    n = own.count()
    if not n:
        return {"error": "no samples"}
    out = {
        "samples": n,
        "feature_diversity": features.diversity(own).first()[0],
        "intra_class_variance": features.intra_class_variance(own).first()[0],
    }
    if real is not None:
        held = sample_features(real.withColumn("key", F.xxhash64("name")), "key").cache()
        out["probe"] = probe.train_probe(own, held, NAMES, trees)
        out["baselines"] = probe.compare_baselines(own, held, NAMES, trees)
        held.unpersist()
    own.unpersist()
    return out


def with_clean(samples: DataFrame, seeds: DataFrame) -> DataFrame:
    """Samples and, as samples without defect, the clean seeds."""
    clean = seeds.select(
        (-1 - F.col("id")).alias("sample_idx"), F.lit("train").alias("split"), F.col("id").alias("seed_id"), F.col("path").alias("source_seed"), F.lit(0).cast("long").alias("random_seed"),
        F.lit("clean").alias("defect_type"), "width", "height", "image", F.repeat(F.lit("\0"), F.col("width") * F.col("height")).cast("binary").alias("mask"),
    )
    return samples.select(*clean.columns).unionByName(clean)


def benchmark_fixtures(spark: SparkSession, size: int = 128, real: int = 12) -> tuple[DataFrame, DataFrame]:
    """Four clean surfaces, and `real` held-out images under other exposure, every other with a defect."""
    from ..sources.images import SURFACES, surface, surfaces
    from . import defects, raster

    rows = []
    for i in range(real):
        rng = np.random.default_rng([99, i])
        image = raster.byte(surface(SURFACES[i % 4], size, 500 + i) * rng.uniform(0.9, 1.1))
        mask = np.zeros((size, size), bool)
        if i % 2:
            image, mask = defects.generator(("scratch", "stain", "crack")[i // 2 % 3])(image, rng, 0.6, 1.0)
        rows.append((f"real_{i:02d}.png", size, size, bytearray(image.tobytes()), bytearray((mask * np.uint8(255)).tobytes())))
    return surfaces(spark, 4, size), spark.createDataFrame(rows, "name string, width int, height int, image binary, mask binary")


def benchmark(spark: SparkSession, folder: str, per_type: int = 30, trees: int = probe.TREES) -> dict:
    """Three timed runs on the fixtures, their quality against the held-out images, and the report."""
    seeds, real = benchmark_fixtures(spark)
    pool, speed = None, {}
    for k, kind in enumerate(("scratch", "stain", "discoloration")):
        path = os.path.join(folder, kind)
        began = time.perf_counter()
        generate(seeds, Config(defect=kind, count=per_type, lighting=0.2, texture=0.15, geometry=0.3)).write.mode("overwrite").parquet(path)
        speed[kind] = round(per_type / max(1e-4, time.perf_counter() - began), 1)
        rows = spark.read.parquet(path).withColumn("sample_idx", F.col("sample_idx") + k * per_type)
        pool = rows if pool is None else pool.unionByName(rows)
    out = {"images_per_second": speed, "quality": evaluate(with_clean(pool, seeds), real, trees)}
    with open(os.path.join(folder, "benchmark_report.json"), "w") as f:
        json.dump(out, f, indent=2)
    return out
