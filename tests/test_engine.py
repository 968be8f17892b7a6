import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from defectlake.catalog import Workspace, run_report
from defectlake.config import Config
from defectlake.operators import features, fusion, labels, measures, pixels, probe, quality, raster, report, spatial
from defectlake.operators.synthesis import generate
from defectlake.plans import planner
from defectlake.sources import export, images


@pytest.fixture(scope="module")
def seed_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("seeds")
    for i in range(3):
        px = np.random.RandomState(i).randint(100, 200, (64, 64, 3)).astype(np.uint8)
        (folder / f"seed_{i:03d}.png").write_bytes(raster.png(px))
    (folder / "broken.PNG").write_text("no image")
    (folder / "notes.txt").write_text("text")
    return str(folder)


@pytest.fixture(scope="module")
def made(spark, seed_folder, tmp_path_factory):
    seeds, _ = images.load_seeds(spark, seed_folder)
    path = str(tmp_path_factory.mktemp("run") / "samples")
    generate(seeds, Config(defect="mixed", count=12, defects_per_image=2)).write.parquet(path)
    return spark.read.parquet(path)


def test_seeds_are_read_in_order_with_warnings(spark, seed_folder):
    seeds, bad = images.load_seeds(spark, seed_folder)
    rows = seeds.orderBy("id").collect()
    assert [os.path.basename(r["path"]) for r in rows] == ["seed_000.png", "seed_001.png", "seed_002.png"]
    px = np.random.RandomState(0).randint(100, 200, (64, 64, 3)).astype(np.uint8)
    assert rows[0]["image"] == px.tobytes() and rows[0]["mean_brightness"] == pytest.approx(px.mean())
    assert [(r["code"], r["severity"]) for r in bad.collect()] == [("corrupt", "error")]


def test_empty_folder_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        images.load_seeds(spark, str(tmp_path))


def test_samples_do_not_depend_on_tasks(spark, seed_folder):
    seeds, _ = images.load_seeds(spark, seed_folder)
    config = Config(defect="scratch", count=6, geometry=0.3, lighting=0.2)
    a = {r["sample_idx"]: (r["image"], r["mask"], r["split"]) for r in generate(seeds, config, 1).collect()}
    b = {r["sample_idx"]: (r["image"], r["mask"], r["split"]) for r in generate(seeds, config, 5).collect()}
    assert a == b and set(a) == set(range(6))


def test_samples_use_each_seed_in_one_split(made):
    assert report.leakage(made).count() == 0
    assert {r["split"] for r in made.select("split").distinct().collect()} == {"train", "val", "test"}
    for r in made.collect():
        union = np.zeros(64 * 64, np.uint8)
        for i in r["instances"]:
            union |= np.frombuffer(i["mask"], np.uint8)
        assert bytes(union) == bytes(r["mask"]) and len(r["instances"]) == 2


def test_coco_export(spark, made, tmp_path):
    counts = export.export_coco(made, str(tmp_path))
    doc = json.loads((tmp_path / "annotations.coco.json").read_text())
    assert counts["images"] == 12 == len(doc["images"]) and [i["id"] for i in doc["images"]] == list(range(1, 13))
    assert [a["id"] for a in doc["annotations"]] == list(range(1, counts["annotations"] + 1)) and all(a["area"] > 0 for a in doc["annotations"])
    for a in doc["annotations"]:
        x, y, w, h = a["bbox"]
        points = [v for border in a["segmentation"] for v in border]
        assert all(x <= v < x + w for v in points[::2]) and all(y <= v < y + h for v in points[1::2])
    assert any(a["segmentation"] for a in doc["annotations"])
    assert [c["id"] for c in doc["categories"]] == list(range(1, len(doc["categories"]) + 1))
    assert len(list((tmp_path / "images").iterdir())) == 12 == len(list((tmp_path / "masks").iterdir()))
    lines = (tmp_path / "metadata.jsonl").read_text().splitlines()
    assert len(lines) == 12 and json.loads(lines[0])["image"].startswith("image_0000_")
    pairs = images.labelled_pairs(spark, str(tmp_path / "images"), str(tmp_path / "masks"))
    assert pairs.count() == 12 and pairs.filter("label = 1").count() >= 11
    assert images.read_metadata(spark, str(tmp_path / "metadata.jsonl")).count() == 12


def test_yolo_and_voc_exports(made, tmp_path):
    found = export.export_yolo(made, str(tmp_path / "yolo"))
    text = (tmp_path / "yolo/data.yaml").read_text()
    assert f"nc: {len(found['names'])}" in text and found["names"] == sorted(found["names"])
    files = list((tmp_path / "yolo/labels").rglob("*.txt"))
    assert len(files) == 12
    for line in files[0].read_text().split("\n")[:-1]:
        assert all(0 <= float(x) <= 1 for x in line.split()[1:])
    export.export_voc(made, str(tmp_path / "voc"))
    assert len(list((tmp_path / "voc/Annotations").iterdir())) == 12
    lists = [p.read_text().split() for p in (tmp_path / "voc/ImageSets/Main").iterdir()]
    assert sum(map(len, lists)) == 12


def test_previews(made, tmp_path):
    assert export.contact_sheet(made, str(tmp_path / "c.png")) == 12
    assert export.html_preview(made, str(tmp_path / "p.html"), 5) == 5 and "5 samples" in (tmp_path / "p.html").read_text()
    px = made.select(F.lit(64).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: i % 200).alias("px"))
    export.heatmap_image(made.sparkSession.createDataFrame([(3, 4, 9)], "y int, x int, hits long"), spatial.mean_image(px.limit(1)), 64, 64, str(tmp_path / "h.png"))
    assert (tmp_path / "h.png").stat().st_size > 100


def test_workspace(spark, seed_folder, tmp_path):
    w = Workspace(spark, str(tmp_path))
    p = w.create("first")["id"]
    for name in sorted(os.listdir(seed_folder)):
        if name.startswith("seed"):
            with open(os.path.join(seed_folder, name), "rb") as f:
                w.add_seed(p, "../../" + name, f.read())
    assert w.seeds(p) == ["seed_000.png", "seed_001.png", "seed_002.png"]
    assert w.seed_report(p).filter("code = 'too_small'").count() == 0
    run = w.create_run(p, Config(count=4, export="coco"))
    assert run["statistics"]["total_images"] == 4 and w.runs(p)[0]["id"] == run["id"] and w.samples(p, run["id"]).count() == 4
    assert w.projects()[0]["runs"] == 1 and w.pack_run(p, run["id"], str(tmp_path / "run.zip")) > 8
    with pytest.raises(ValueError):
        w.add_seed(p, "x.exe", b"")
    w.delete(p)
    assert w.projects() == []


def test_report(made):
    doc = run_report(made)
    assert doc["statistics"]["total_images"] == 12 and doc["statistics"]["total_annotations"] == 24 and doc["leaked_seeds"] == 0
    light = [np.frombuffer(r["image"], np.uint8).mean() for r in made.select("image").collect()]
    assert doc["statistics"]["mean_brightness"] == pytest.approx(np.mean(light)) and doc["brightness_distribution"]["high"] == pytest.approx(max(light))
    assert sum(doc["validation"].values()) == 12 and not set(doc["validation"]) - {"valid", "empty_mask"}
    assert doc["output_duplicates"]["total"] == 12


def test_marks_of_images(spark):
    rng = np.random.default_rng(0)
    small = rng.integers(0, 256, (8, 9), np.uint8)
    rows = [(1, 9, 8, np.repeat(small[..., None], 3, 2).tobytes(), bytes(72)), (2, 90, 80, np.repeat(np.kron(small, np.ones((10, 10), np.uint8))[..., None], 3, 2).tobytes(), b"\x01"), (3, 0, 0, None, None)]
    found = {r["id"]: r for r in pixels.marks(spark.createDataFrame(rows, "id long, width int, height int, image binary, mask binary"), "id").collect()}
    want = int("".join(str(int(b)) for b in (small[:, 1:] > small[:, :-1]).ravel()), 2)
    assert found[1]["hash"] % 2**64 == want == found[2]["hash"] % 2**64 and found[3]["hash"] is None
    assert found[1]["brightness"] == pytest.approx(small.mean()) and found[1]["mask_size"] and not found[2]["mask_size"] and not found[2]["mask_values"]


def mask_row(spark, mask, px=None):
    h, w = mask.shape
    px = np.full(mask.shape, 100) if px is None else px
    return spark.createDataFrame([(1, w, h, px.ravel().tolist(), mask.astype(int).ravel().tolist())], "id long, width int, height int, px array<int>, mask array<int>")


def test_box_area_and_yolo(spark):
    mask = np.zeros((100, 100), int)
    mask[20:60, 30:70] = 255
    box = measures.bbox(F.col("mask"), F.col("width"))
    r = mask_row(spark, mask).select(box.alias("b"), measures.area(F.col("mask")).alias("a"), measures.yolo_box(box, F.col("width"), F.col("height")).alias("y")).first()
    assert tuple(r["b"]) == (30, 20, 40, 40) and r["a"] == 1600 and tuple(r["y"]) == (0.5, 0.4, 0.4, 0.4)
    r = mask_row(spark, np.zeros((5, 4), int)).select(box.alias("b"), measures.yolo_box(box, F.col("width"), F.col("height")).alias("y")).first()
    assert tuple(r["b"]) == (0, 0, 0, 0) and tuple(r["y"]) == (0.0, 0.0, 0.0, 0.0)


def test_validity_codes(spark):
    m = F.col("mask")
    codes = lambda df, n: df.select(measures.validity(m, F.size(m), F.lit(n), measures.area(m), measures.bbox(m, F.col("width"))).alias("c")).first()["c"]
    odd = np.zeros((8, 8), int)
    odd[0, 0] = 128
    assert codes(mask_row(spark, odd), 64) == ["invalid_mask"]
    assert codes(mask_row(spark, np.zeros((8, 8), int)), 64) == ["empty_mask"]
    assert codes(mask_row(spark, np.full((4, 4), 255)), 64) == ["shape_mismatch"]


def test_hash_distances(spark):
    half = np.repeat(np.where(np.arange(64) < 32, 200, 100)[None], 64, 0)
    rows = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate((half, half, half[:, ::-1]))], "id int, px array<int>")
    h = [r["h"] for r in rows.select(measures.dhash(F.col("px"), 64, 64).alias("h")).collect()]
    assert h[0] == h[1] and bin((h[0] ^ h[2]) & (2**64 - 1)).count("1") >= 8


def test_near_pairs_equal_comparison(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    for k in range(60):
        v = int(values[k])
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            v ^= -(1 << 63) if b == 63 else 1 << int(b)
        values[200 + k] = v
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "id long, hash long")
    for t in (0, 1, 4, 6):
        a = {tuple(r) for r in quality.near_pairs(rows, t).collect()}
        assert a == {tuple(r) for r in quality.near_pairs_by_comparison(rows, t).collect()}
    warned = quality.duplicate_warnings(quality.near_pairs(rows, 4))
    assert {r["code"] for r in warned.collect()} == {"duplicate", "near_duplicate"}


def _near_copies(spark, n: int):
    """Rows of hashes of 56 bits with copies, near copies, ids that occur twice or are null, and null hashes."""
    rng = np.random.default_rng(8)
    values = rng.integers(0, 2**56, n)
    for k in range(n // 20, n // 2):
        values[k] = values[k % (n // 20)] ^ sum(1 << int(b) for b in rng.choice(56, rng.integers(0, 12), replace=False))
    rows = [(i if i % 97 else 3, int(v)) for i, v in enumerate(values)]
    return spark.createDataFrame([*rows, (None, rows[0][1]), (n, None)], "id long, hash long")


@pytest.mark.parametrize("rows", [100, 100000])
def test_wide_thresholds_compare_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "BLOCK_ROWS", (rows, rows))
    hashes = _near_copies(spark, 700)
    pairs = quality.near_pairs(hashes, 14, 56)
    want = sorted(map(tuple, quality.near_pairs_by_comparison(hashes, 14).collect()))
    assert len(want) > 1000 and {r[2] for r in want} == set(range(15)) and sorted(map(tuple, pairs.collect())) == want
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # no candidates of bands
    names = hashes.select(F.concat(F.lit("n"), "id").alias("id"), "hash")
    assert quality.near_pairs(names, 14, 56).count() == quality.near_pairs_by_comparison(names, 14).count()
    assert quality.near_pairs(hashes.limit(0), 14, 56).count() == 0


def test_copies_are_expanded_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(quality, "EXPANDED", 50)
    one = [{"hash": 0, "ids": list(range(0, 60, 2))}, {"hash": 1, "ids": [1]}, {"hash": 2**55 - 1, "ids": [7, 7]}]
    two = [{"hash": 3, "ids": list(range(1, 60, 3))}]
    for blocks in ([one], [one, two]):
        parts = list(quality._expanded([pa.array(b, pa.struct({"hash": pa.int64(), "ids": pa.list_(pa.int64())})) for b in blocks], 14))
        assert max(p.num_rows for p in parts) <= 50
        rows = [[(i, r["hash"]) for r in b for i in r["ids"]] for b in blocks]
        sides = [(x, y) for k, x in enumerate(rows[0]) for y in rows[0][k + 1 :]] if len(rows) == 1 else [(x, y) for x in rows[0] for y in rows[1]]
        want = sorted((min(i, j), max(i, j), (g ^ h).bit_count()) for (i, g), (j, h) in sides if i != j and (g ^ h).bit_count() <= 14)
        assert sorted(tuple(r.values()) for p in parts for r in p.to_pylist()) == want


@pytest.mark.parametrize("rows", [100, 100000])
def test_summary_counts_pairs_by_hash(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "BLOCK_ROWS", (rows, rows))
    hashes = _near_copies(spark, 700)
    for some in (hashes, hashes.filter("id = 3"), hashes.filter("id % 90 = 0"), hashes.limit(0)):
        want = quality.duplicate_summary(some, quality.near_pairs_by_comparison(some, 14)).first()
        assert quality.near_summary(some, 14, 56).first() == want
    assert quality.near_summary(hashes).first() == quality.duplicate_summary(hashes, quality.near_pairs_by_comparison(hashes)).first()


def test_summary_does_not_expand_copies(spark):
    copies = spark.range(300000).select("id", F.lit(5).cast("long").alias("hash"))
    assert tuple(quality.near_summary(copies, 14, 56).first()) == (300000, 300000 * 299999 // 2, 0)


def test_warnings_of_wide_thresholds(spark):
    hashes = _near_copies(spark, 700)
    got = quality.duplicate_warnings(quality.near_pairs(hashes, 14, 56))
    want = quality.duplicate_warnings(quality.near_pairs_by_comparison(hashes, 14))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("change,code", [({"mean_brightness": 20.0}, "too_dark"), ({"mean_brightness": 240.0}, "too_bright"), ({"blur_score": 50.0}, "blurry"), ({"width": 40}, "too_small"), ({"width": 9000}, "too_large"), ({"height": 200}, "odd_dimensions")])
def test_each_rule_fires(spark, change, code):
    base = {"id": 1, "width": 100, "height": 100, "mean_brightness": 127.0, "blur_score": 200.0}
    rows = [base | {"id": k} for k in range(5)] + [base | change | {"id": 9}]
    found = {(r["id"], r["code"]) for r in quality.warnings(spark.createDataFrame(rows)).collect()}
    assert (9, code) in found and all(i == 9 for i, _ in found)


def test_outliers_leakage_and_balance(spark):
    rows = spark.createDataFrame([(k, 100.0, 5.0) for k in range(10)] + [(10, 255.0, 5.0)], "id int, b double, c double")
    assert [tuple(r) for r in quality.outliers(rows, {"brightness": "b", "contrast": "c"}).collect()] == [(10, "brightness")]
    rows = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "train")], "source_seed string, split string")
    assert [(r["source_seed"], r["splits"]) for r in report.leakage(rows).collect()] == [("a", ["train", "val"])]
    split = lambda n: spark.createDataFrame([("train",)] * 10 + [("val",)] * n, "split string")
    assert report.split_balance(split(2)).first()["is_balanced"] and not report.split_balance(split(1)).first()["is_balanced"]


def test_empty_statistics_are_zero(spark):
    rows = spark.createDataFrame([], "area_percent double, brightness double, annotations int")
    r = report.statistics(rows).first()
    assert r["total_images"] == 0 and r["mean_area_percent"] == 0 and r["success_rate"] == 0


def test_spatial_metrics(spark):
    def run(hits):
        rows = [(int(y), int(x), int(hits[y, x])) for y, x in zip(*np.nonzero(hits), strict=True)]
        return spatial.metrics(spark.createDataFrame(rows, "y int, x int, hits long"), 100, 100).first()

    none = run(np.zeros((100, 100), int))
    assert none["coverage"] == 0 and none["entropy"] == 0 and none["centroid_x"] == 0.5
    corner = np.zeros((100, 100), int)
    corner[:20, :20] = 10
    assert run(corner)["coverage"] == pytest.approx(0.04) and run(corner)["entropy"] < 0.5
    assert run(np.full((100, 100), 5))["entropy"] > 0.95


def test_merging_runs(spark):
    pictures = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "run_idx int, id long, file_name string")
    categories = spark.createDataFrame([(1, 1, "scratch"), (2, 1, "crack")], "run_idx int, id long, name string")
    notes = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 1), (2, 1, 1, 1), (2, 2, 7, 1), (2, 3, 1, 5)], "run_idx int, id long, image_id long, category_id long")
    merged, names = fusion.merge_images(pictures), fusion.merge_categories(categories)
    assert sorted((r["id"], r["file_name"]) for r in merged.collect()) == [(1, "run1_a"), (2, "run1_b"), (3, "run2_c")]
    assert sorted((r["id"], r["name"]) for r in names.collect()) == [(1, "scratch"), (2, "crack")]
    rows = fusion.merge_annotations(notes, merged, categories, names).collect()
    assert sorted((r["id"], r["image_id"], r["category_id"]) for r in rows) == [(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 1)]


def test_plan_covers_all_samples(spark):
    seeds = spark.range(10)
    plan = planner.split_plan(seeds, 10)
    rows = planner.sample_plan(plan, planner.quota(10, 50, spark), 50).collect()
    assert sorted(r["sample_idx"] for r in rows) == list(range(50)) and len({r["random_seed"] for r in rows}) == 50
    owner = {r["id"]: r["split"] for r in plan.collect()}
    assert all(owner[r["seed_id"]] == r["split"] for r in rows)


def test_features_and_probe(spark):
    def rows(n, seed):
        rng, out = np.random.default_rng(seed), []
        for k in range(n):
            px, mask = rng.integers(90, 160, (12, 12)), np.zeros((12, 12), int)
            if k % 2:
                mask[3:8, 3:8] = 255
                px[3:8, 3:8] = 20
            out.append((k, 12, 12, px.ravel().tolist(), mask.ravel().tolist(), k % 2))
        return spark.createDataFrame(out, "id long, width int, height int, px array<int>, mask array<int>, label int")

    def table(n, seed):
        base = rows(n, seed)
        return features.extract(base).join(base.select("id", "label"), "id").cache()

    synthetic, real = table(24, 1), table(12, 2)
    names = [c for c in synthetic.columns if c not in ("id", "label")]
    assert len(names) == 8 and features.diversity(synthetic).first()[0] > 0 and features.intra_class_variance(synthetic).first()[0] > 0
    found = probe.train_probe(synthetic, real, names, trees=3)
    assert found["cv_accuracy"] > 0.9 and found["real_f1"] > 0.9 and set(found["importances"]) == set(names)
    assert "error" in probe.train_probe(synthetic.filter("label = 1"), real, names, trees=2)
    out = probe.compare_baselines(synthetic, real, names, trees=2)
    assert {"real_only", "synthetic_only", "augmented", "lift"} <= set(out)
    assert "error" in probe.compare_baselines(synthetic, real.limit(3), names)


def test_polygons(spark):
    mask = np.zeros((10, 12), int)
    mask[2:6, 3:9] = 255
    assert labels.polygons(mask_row(spark, mask)).first()["polygons"] == [[3, 2, 8, 2, 8, 5, 3, 5]]


def test_streams(spark, tmp_path):
    from defectlake.streaming.ingest import rates, seed_stream

    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.png").write_bytes(raster.png(np.full((8, 8, 3), 90, np.uint8)))
    q = seed_stream(spark, str(folder)).writeStream.format("memory").queryName("seeds_now").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seeds_now").first()["mean_brightness"] == 90
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 4.0)], "ts string, k string, v double").select(F.col("ts").cast("timestamp").alias("ts"), "k", "v").write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "events"))
    q = rates(events, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("rates_now").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["n"], r["total"]) for r in spark.table("rates_now").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_all_kinds_of_surfaces(spark):
    assert {r["path"].rsplit("_", 1)[0] for r in images.surfaces(spark, 5, 32).select("path").collect()} == set(images.SURFACES)


def test_seed_report_has_duplicates(spark, seed_folder, tmp_path):
    w = Workspace(spark, str(tmp_path))
    p = w.create("copies")["id"]
    with open(os.path.join(seed_folder, "seed_000.png"), "rb") as f:
        data = f.read()
    for name in ("a.png", "b.png"):
        w.add_seed(p, name, data)
    assert [r["path"].rsplit("/", 1)[-1] for r in w.seed_report(p).filter("code = 'duplicate'").collect()] == ["b.png"]


def test_surfaces(spark):
    rows = images.surfaces(spark, 4, 32).collect()
    assert len(rows) == 4 and all(len(r["image"]) == 32 * 32 * 3 for r in rows)


def test_benchmark(spark, tmp_path):
    from defectlake.operators.evaluation import NAMES, benchmark

    out = benchmark(spark, str(tmp_path), per_type=6, trees=2)
    assert len(NAMES) == 16 and out["quality"]["samples"] == 22 and out["quality"]["feature_diversity"] > 0
    assert "real_f1" in out["quality"]["probe"] and "augmented" in out["quality"]["baselines"]
    assert (tmp_path / "benchmark_report.json").exists()


def test_command_line(spark, seed_folder, tmp_path, capsys):
    from defectlake import cli

    for k in (1, 2):
        assert cli.main(["generate", seed_folder, str(tmp_path / f"run{k}"), "--defect", "mixed", "--count", "4", "--random-seed", str(k)]) == 0
    assert cli.main(["merge", str(tmp_path / "all"), str(tmp_path / "run1"), str(tmp_path / "run2")]) == 0
    assert spark.read.parquet(str(tmp_path / "all/images")).count() == 8
    assert cli.main(["recipes"]) == 0 and "metal" in capsys.readouterr().out


def test_dense_ids_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fusion, "RANGE", 3)
    rows = [(r, i) for r in (2, 1) for i in (0, 1, 2, 5, 6, 7, 30, 31)]
    got = fusion.dense_ids(spark.createDataFrame(rows, "run_idx int, id long"), "n", "run_idx", "id", ranged="id", runs="run_idx").collect()
    assert [(r["run_idx"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows) and sorted(r["n"] for r in got) == list(range(1, 17))
