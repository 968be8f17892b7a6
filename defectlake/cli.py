"""Command line: `python -m defectlake.cli generate SEEDS OUT --recipe metal`, and others."""

from __future__ import annotations

import argparse
import json
import os

from .config import RECIPES, TYPES, recipe


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("defectlake").getOrCreate()


def generate(a) -> None:
    from .catalog import run_report
    from .config import Config
    from .operators.synthesis import generate as make
    from .sources import export, images

    given = {k: getattr(a, k) for k in ("defect", "count", "severity", "frequency", "random_seed", "export", "defects_per_image")}
    config = recipe(a.recipe).config(**given) if a.recipe else Config(**{k: v for k, v in given.items() if v is not None})
    spark = _spark()
    seeds, _ = images.load_seeds(spark, a.seeds)
    make(seeds, config).write.mode("overwrite").parquet(os.path.join(a.out, "samples"))
    samples = spark.read.parquet(os.path.join(a.out, "samples"))
    for kind in ("coco", "yolo", "voc") if config.export == "all" else (config.export,):
        getattr(export, f"export_{kind}")(samples, a.out if kind == "coco" else os.path.join(a.out, kind))
    export.contact_sheet(samples, os.path.join(a.out, "contact_sheet.png"))
    export.html_preview(samples, os.path.join(a.out, "preview.html"))
    with open(os.path.join(a.out, "report.json"), "w") as f:
        json.dump(run_report(samples), f, default=str)
    print(f"wrote {config.count} samples to {a.out}")


def merge(a) -> None:
    from .operators import fusion
    from .sources import images

    spark = _spark()
    pictures, notes, categories = images.read_coco(spark, [os.path.join(d, "annotations.coco.json") for d in a.runs])
    merged, names = fusion.merge_images(pictures), fusion.merge_categories(categories)
    merged.write.mode("overwrite").parquet(os.path.join(a.out, "images"))
    fusion.merge_annotations(notes, merged, categories, names).write.mode("overwrite").parquet(os.path.join(a.out, "annotations"))
    names.write.mode("overwrite").parquet(os.path.join(a.out, "categories"))
    print(f"merged {len(a.runs)} runs into {a.out}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="defectlake")
    sub = p.add_subparsers(dest="what", required=True)
    g = sub.add_parser("generate", help="synthesise a dataset from a folder of clean images")
    g.add_argument("seeds")
    g.add_argument("out")
    g.add_argument("--recipe", choices=sorted(RECIPES))
    g.add_argument("--defect", choices=[*TYPES, "mixed"])
    for name, kind in (("count", int), ("severity", float), ("frequency", float), ("random-seed", int), ("defects-per-image", int)):
        g.add_argument(f"--{name}", type=kind)
    g.add_argument("--export", choices=["coco", "yolo", "voc", "all"])
    g.set_defaults(run=generate)
    m = sub.add_parser("merge", help="merge exported runs under new ids")
    m.add_argument("out")
    m.add_argument("runs", nargs="+")
    m.set_defaults(run=merge)
    r = sub.add_parser("recipes", help="list recipes")
    r.set_defaults(run=lambda a: print("\n".join(f"{x.name}: {x.title}" for x in RECIPES.values())))
    a = p.parse_args(argv)
    a.run(a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
