"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
NAMES = [
    "seed_quality_warnings",
    "mask_bbox",
    "near_duplicates",
    "dataset_statistics",
    "split_statistics",
    "split_leakage",
    "brightness_outliers",
    "sample_plan",
    "coco_annotations",
    "yolo_lines",
    "merge_annotations",
    "spatial_metrics",
    "gray_features",
    "intra_class_variance",
]
#: Images of 256 x 256 from two seeds, with the settings of the published throughput.
SYNTHESIS = {"scratch": 2000, "stain": 2000, "discoloration": 2000}


def main() -> None:
    from pyspark.sql import SparkSession

    from defectlake.config import Config
    from defectlake.operators.synthesis import generate
    from defectlake.queries import QUERIES
    from defectlake.sources.images import surfaces

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for name in NAMES:
        done(QUERIES[name](spark, FOLDER))  # compiles and reads once
        best = None
        for _ in range(2):
            began = time.perf_counter()
            done(QUERIES[name](spark, FOLDER))
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    seeds, rate = surfaces(spark, 2), {}
    for kind, n in SYNTHESIS.items():
        config = Config(defect=kind, count=n, lighting=0.2, texture=0.1, geometry=0.3, sensor=0.0, split=False)
        done(generate(seeds, Config(defect=kind, count=4 * CPUS, split=False), CPUS))
        began = time.perf_counter()
        done(generate(seeds, config, 4 * CPUS))
        spent = time.perf_counter() - began
        took[f"synth_{kind}"], rate[kind] = round(spent, 3), round(n / spent, 1)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "images_per_second": rate, "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": CPUS}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
