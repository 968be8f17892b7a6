"""Synthesis of labelled samples: plan, join with seeds, one Arrow pass per sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..plans import planner
from . import defects

SAMPLES = (
    "sample_idx long, split string, seed_id long, source_seed string, random_seed long, defect_type string, width int, height int, image binary, mask binary, "
    "instances array<struct<defect_type:string,mask:binary,x:int,y:int,w:int,h:int,area:int>>, metadata map<string,string>"
)
_TYPES = [
    pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(),
    pa.list_(pa.struct([("defect_type", pa.string()), ("mask", pa.binary()), *[(k, pa.int32()) for k in ("x", "y", "w", "h", "area")]])),
    pa.map_(pa.string(), pa.string()),
]


def box_of(mask: np.ndarray) -> tuple[int, int, int, int]:
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return 0, 0, 0, 0
    return int(columns[0]), int(rows[0]), int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)


def make_sample(image: np.ndarray, roi: np.ndarray | None, seed: int, config: Config, index: int = 0) -> tuple[np.ndarray, list[tuple[str, np.ndarray]]]:
    """The changed image and its instances, by one random stream of the sample's own seed."""
    rng = np.random.default_rng(seed)
    current, found = image, []
    for k in range(config.passes):
        name = config.defect
        if name == "mixed":
            kinds = config.mixed_types
            name = kinds[(index * config.passes + k) % len(kinds)] if config.round_robin else str(rng.choice(kinds))
        changed, mask = defects.generator(name)(current, rng, config.severity, config.frequency)
        if roi is not None and not roi.all():
            changed = np.where(roi[..., None], changed, current)
            mask = mask & roi
        current = changed
        found.append((name, mask))
    current, masks = defects.randomise(image, current, [m for _, m in found], rng, config)
    return current, list(zip([n for n, _ in found], masks, strict=True))


def plan(seeds: DataFrame, config: Config) -> DataFrame:
    """sample_idx, split, seed_id and random_seed; without splits all samples train on all seeds."""
    ids = seeds.select("id")
    n = ids.count()
    if not n:
        raise ValueError("there are no seeds")
    ratios = config.ratios if config.split else planner.Ratios(1, 0, 0)
    quotas = planner.quota(n, config.count, seeds.sparkSession, ratios)
    return planner.sample_plan(planner.split_plan(ids, n, ratios), quotas, config.count, config.random_seed)


def generate(seeds: DataFrame, config: Config, tasks: int | None = None) -> DataFrame:
    """Samples of a run. `seeds` has id, path, width, height and image (BGR bytes).

    The result does not depend on the number of tasks: each sample draws from its own seed. Regions
    of interest are found once per seed, before the join. A seed's image meets its samples by an
    equi-join, whose skew AQE splits; nothing of the samples is held but one Arrow batch.
    """
    pixels = seeds.select("id", "path", "width", "height", "image")

    def with_roi(batches):
        for batch in batches:
            rois = []
            for w, h, data in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                rois.append(np.packbits(defects.region_of_interest(np.frombuffer(data, np.uint8).reshape(h, w, 3))).tobytes() if config.auto_roi else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rois, pa.binary())], ["id", "path", "width", "height", "image", "roi"])

    ready = pixels.mapInArrow(with_roi, "id long, path string, width int, height int, image binary, roi binary")
    joined = plan(seeds, config).join(ready, F.col("seed_id") == F.col("id"))
    if tasks:
        joined = joined.repartition(tasks, "sample_idx")
    columns = ["sample_idx", "split", "seed_id", "path", "random_seed", "width", "height", "image", "roi"]

    def synthesise(batches):
        names = [c.split()[0] for c in SAMPLES.replace("array<struct<defect_type:string,mask:binary,x:int,y:int,w:int,h:int,area:int>>", "a").replace("map<string,string>", "m").split(", ")]
        for batch in batches:
            for first in range(0, batch.num_rows, 32):
                rows = []
                for r in batch.slice(first, 32).to_pylist():
                    h, w = r["height"], r["width"]
                    image = np.frombuffer(r["image"], np.uint8).reshape(h, w, 3)
                    roi = np.unpackbits(np.frombuffer(r["roi"], np.uint8))[: h * w].reshape(h, w).astype(bool) if r["roi"] else None
                    out, found = make_sample(image, roi, r["random_seed"], config, r["sample_idx"])
                    union = np.logical_or.reduce([m for _, m in found])
                    instances = [dict(zip(("defect_type", "mask", "x", "y", "w", "h", "area"), (n, (m * np.uint8(255)).tobytes(), *box_of(m), int(m.sum())), strict=True)) for n, m in found]
                    kind = found[0][0] if len(found) == 1 else "compound"
                    meta = [("defect_types", ",".join(n for n, _ in found)), ("num_instances", str(len(found))), ("compound", str(len(found) > 1).lower()), ("auto_roi", str(config.auto_roi).lower()), ("severity", str(config.severity)), ("frequency", str(config.frequency))]
                    rows.append((r["sample_idx"], r["split"], r["seed_id"], r["path"], r["random_seed"], kind, w, h, out.tobytes(), (union * np.uint8(255)).tobytes(), instances, meta))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    return joined.select(*columns).mapInArrow(synthesise, SAMPLES)
