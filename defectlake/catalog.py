"""Projects and runs in a workspace folder: small JSON documents beside Parquet sample tables."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import asdict
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import pixels, quality, report, spatial
from .operators.synthesis import generate
from .sources import export, images


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _read(path: Path) -> dict | None:
    try:
        return json.loads(path.read_text())
    except (OSError, ValueError):
        return None


class Workspace:
    """Creates, lists and deletes projects, their seeds and their runs."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _at(self, project: str) -> Path:
        path = self.folder / export.safe_name(project)
        if not (path / "project.json").exists():
            raise FileNotFoundError(f"no project {project}")
        return path

    def create(self, name: str, description: str = "") -> dict:
        if not name.strip():
            raise ValueError("a project needs a name")
        doc = {"id": uuid.uuid4().hex[:8], "name": name.strip(), "description": description, "created_at": _now()}
        path = self.folder / doc["id"]
        (path / "seeds").mkdir(parents=True)
        (path / "project.json").write_text(json.dumps(doc))
        return doc

    def projects(self) -> list[dict]:
        """Newest first, with the numbers of seeds and runs; broken documents are left out."""
        found = [(p.parent, _read(p)) for p in self.folder.glob("*/project.json")]
        docs = [d | {"seeds": len(self.seeds(d["id"])), "runs": len(self.runs(d["id"]))} for _, d in found if d]
        return sorted(docs, key=lambda d: d["created_at"], reverse=True)

    def delete(self, project: str) -> None:
        shutil.rmtree(self._at(project))

    def add_seed(self, project: str, name: str, data: bytes) -> str:
        clean = export.safe_name(name)
        if clean.rsplit(".", 1)[-1].lower() not in images.SUFFIXES:
            raise ValueError(f"not an image name: {name}")
        (self._at(project) / "seeds" / clean).write_bytes(data)
        return clean

    def seeds(self, project: str) -> list[str]:
        return sorted(p.name for p in (self._at(project) / "seeds").iterdir() if p.is_file())

    def remove_seed(self, project: str, name: str) -> None:
        (self._at(project) / "seeds" / export.safe_name(name)).unlink()

    def runs(self, project: str) -> list[dict]:
        """Newest first."""
        found = [_read(p) for p in self._at(project).glob("runs/*/run.json")]
        return sorted((d for d in found if d), key=lambda d: d["created_at"], reverse=True)

    def seed_report(self, project: str) -> DataFrame:
        """Warnings of all rules, near-duplicates and unreadable files."""
        seeds, bad = images.load_seeds(self.spark, str(self._at(project) / "seeds"))
        rules = quality.warnings(seeds.select("id", "width", "height", "mean_brightness", "blur_score"))
        pairs = quality.near_pairs(pixels.marks(seeds, "id").filter("hash is not null").select("id", "hash"))
        copies = quality.duplicate_warnings(pairs).select("id", "code", F.lit("warning").alias("severity"), F.format_string("%d bits from image %d", "distance", "of").alias("message"))
        found = rules.unionByName(copies).join(seeds.select("id", "path"), "id")
        return found.select("path", "code", "message", "severity").unionByName(bad)

    def create_run(self, project: str, config: Config) -> dict:
        """Synthesises a run, writes samples, exports, previews and the report, and records it."""
        path = self._at(project)
        seeds, _ = images.load_seeds(self.spark, str(path / "seeds"))
        run = uuid.uuid4().hex[:8]
        folder = path / "runs" / run
        folder.mkdir(parents=True)
        generate(seeds, config).write.parquet(str(folder / "samples"))
        samples = self.spark.read.parquet(str(folder / "samples"))
        kinds = ("coco", "yolo", "voc") if config.export == "all" else (config.export,)
        for kind in kinds:
            getattr(export, f"export_{kind}")(samples, str(folder if kind == "coco" else folder / kind))
        export.contact_sheet(samples, str(folder / "contact_sheet.png"))
        export.html_preview(samples, str(folder / "preview.html"))
        export.training_scripts(str(folder / "scripts"))
        summary = run_report(samples)
        (folder / "report.json").write_text(json.dumps(summary, default=str))
        doc = {"id": run, "project": project, "created_at": _now(), "status": "completed", "config": asdict(config), "statistics": summary["statistics"]}
        (folder / "run.json").write_text(json.dumps(doc, default=str))
        return doc

    def samples(self, project: str, run: str) -> DataFrame:
        path = self._at(project) / "runs" / export.safe_name(run) / "samples"
        if not os.path.isdir(path):
            raise FileNotFoundError(f"no run {run}")
        return self.spark.read.parquet(str(path))


    def pack_run(self, project: str, run: str, path: str) -> int:
        """Writes all files of a run into one ZIP file; returns their number."""
        import zipfile

        folder = self._at(project) / "runs" / export.safe_name(run)
        if not folder.is_dir():
            raise FileNotFoundError(f"no run {run}")
        files = sorted(p for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in files:
                z.write(p, p.relative_to(folder))
        return len(files)


def run_report(samples: DataFrame) -> dict:
    """Statistics, validation, leakage, splits, duplicates, brightness and spatial measures of a run.

    Pixels are read once, for brightness, hashes and the masks' values.
    """
    seen = pixels.marks(samples, "sample_idx").cache()
    samples = samples.withColumn("id", F.col("sample_idx")).drop("image", "mask").join(seen, "id")
    area = F.aggregate("instances", F.lit(0).cast("long"), lambda a, i: a + i["area"])
    rows = samples.select(
        "split",
        "source_seed",
        "defect_type",
        F.least(area * 100.0 / (F.col("width") * F.col("height")), F.lit(100.0)).alias("area_percent"),
        "brightness",
        F.size("instances").alias("annotations"),
    )
    boxes = samples.select("width", "height", F.inline("instances"))
    centre = boxes.filter("area > 0").select(F.least(F.lit(63), ((F.col("y") + F.col("h") / 2) * 64 / F.col("height")).cast("int")).alias("y"), F.least(F.lit(63), ((F.col("x") + F.col("w") / 2) * 64 / F.col("width")).cast("int")).alias("x"))
    one = lambda df: df.first().asDict(True)
    bad_box = F.exists("instances", lambda i: (i["area"] > 0) & ((i["w"] <= 0) | (i["h"] <= 0)))
    codes = F.array_compact(F.array(F.when(~F.col("mask_size"), "shape_mismatch"), F.when(~F.col("mask_values"), "invalid_mask"), F.when(area == 0, "empty_mask"), F.when(bad_box, "invalid_bbox")))
    hashes = seen.filter("hash is not null").select("id", "hash")
    found = {
        "statistics": one(report.statistics(rows)),
        "defects": {r["defect_type"]: r["n"] for r in report.counts_by(rows, "defect_type").collect()},
        "splits": [r.asDict(True) for r in report.split_statistics(rows).collect()],
        "balance": one(report.split_balance(rows)),
        "leaked_seeds": report.leakage(rows).count(),
        "spatial_distribution": one(spatial.metrics(spatial.heat(centre), 64, 64)),
        "validation": {r["code"]: r["n"] for r in report.validation(samples.select(codes.alias("codes"))).collect()},
        "output_duplicates": one(quality.duplicate_summary(hashes, quality.near_pairs(hashes))),
        "brightness_distribution": one(quality.distribution(seen, {"brightness": "brightness"})),
    }
    seen.unpersist()
    return found
