"""Leak-free plans: which seed belongs to which split, and which seed each sample uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import lcg

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Ratios:
    train: float = 0.7
    val: float = 0.2
    test: float = 0.1

    def normal(self) -> tuple[float, float, float]:
        parts = [max(0.0, x) for x in (self.train, self.val, self.test)]
        whole = sum(parts)
        return tuple(x / whole for x in parts) if whole else (0.7, 0.2, 0.1)


def seed_counts(n: int, ratios: Ratios = Ratios()) -> dict[str, int]:
    """Seeds per split: train has one at least; with three seeds val and test are not starved."""
    train, val, test = ratios.normal()
    if n <= 0:
        return dict.fromkeys(SPLITS, 0)
    if n == 1:
        return {"train": 1, "val": 0, "test": 0}
    if n == 2:
        return {"train": 1, "val": 1, "test": 0}
    a = min(n, max(1, round(n * train)))
    b = min(n - a, max(1, round(n * val)) if val > 0 else 0)
    c = n - a - b
    if val > 0 and b == 0 and a > 1:
        a, b = a - 1, 1
    if test > 0 and c == 0:
        if a > 1:
            a, c = a - 1, 1
        elif b > 1:
            b, c = b - 1, 1
    if test == 0:
        a, c = a + c, 0
    return {"train": a, "val": b, "test": c}


def sample_counts(total: int, seeds: dict[str, int], ratios: Ratios = Ratios()) -> dict[str, int]:
    """Samples per split with seeds; the last of them takes what rounding leaves."""
    active = [s for s in SPLITS if seeds.get(s)]
    share = dict(zip(SPLITS, ratios.normal(), strict=True))
    whole = sum(share[s] for s in active) or 1.0
    out, left = {}, total
    for s in active:
        out[s] = left if s == active[-1] else min(left, round(total * share[s] / whole))
        left -= out[s]
    return out


def split_plan(seeds: DataFrame, n: int, ratios: Ratios = Ratios(), order: Column | None = None) -> DataFrame:
    """id, pos (rank in the shuffled order, from 0), split and its place within the split.

    The order is a pseudo-random function of the id. Seeds are few next to samples; the one window
    over them sorts ids only.
    """
    order = lcg(F.col("id")) if order is None else order
    counts = seed_counts(n, ratios)
    a, b = counts["train"], counts["train"] + counts["val"]
    pos = F.row_number().over(Window.orderBy(order, "id")) - 1
    split = F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").otherwise("test")
    first = F.when(F.col("pos") < a, 0).when(F.col("pos") < b, a).otherwise(b)
    return seeds.select("id", pos.alias("pos")).select("id", "pos", split.alias("split"), (F.col("pos") - first).cast("int").alias("place"))


def quota(n_seeds: int, total: int, spark, ratios: Ratios = Ratios()) -> DataFrame:
    """split, seeds, samples and the index of its first sample."""
    seeds, first, rows = seed_counts(n_seeds, ratios), 0, []
    for s, k in sample_counts(total, seeds, ratios).items():
        rows.append((s, seeds[s], k, first))
        first += k
    return spark.createDataFrame(rows, "split string, seeds int, samples int, first int")


def sample_plan(plan: DataFrame, quotas: DataFrame, total: int, random_seed: int = 42) -> DataFrame:
    """sample_idx, split, seed id and random_seed: within a split samples go round its seeds.

    The sample table comes from a range, and joins the seeds of its split by equality.
    """
    rows = plan.sparkSession.range(total).withColumnRenamed("id", "sample_idx")
    here = (F.col("sample_idx") >= F.col("first")) & (F.col("sample_idx") < F.col("first") + F.col("samples"))
    placed = rows.join(F.broadcast(quotas), here).withColumn("place", F.pmod(F.col("sample_idx") - F.col("first"), F.col("seeds")).cast("int"))
    joined = placed.join(plan.select(F.col("id").alias("seed_id"), "split", "place"), ["split", "place"])
    return joined.select("sample_idx", "split", "seed_id", sample_seed(F.lit(random_seed), F.col("sample_idx")).alias("random_seed"))


def sample_seed(random_seed: Column, sample_idx: Column, step: Column | None = None) -> Column:
    """A seed below 2^32 that mixes run, sample and pass, so that near runs share none."""
    prime = F.lit(2147483647).cast("long")
    mixed = F.pmod(random_seed.cast("long"), prime) * 1000003 + F.pmod(sample_idx.cast("long"), prime) * 8191 + (step.cast("long") if step is not None else F.lit(0).cast("long"))
    return F.pmod(F.pmod(mixed, F.lit(2147483647).cast("long")) * F.lit(1664525).cast("long") + F.lit(1013904223).cast("long"), F.lit(4294967296).cast("long"))


def holdout(rows: DataFrame, label: str = "label", share: float = 0.4, key: str = "id") -> DataFrame:
    """Rows with `held_out`: of each label the first `share` of a pseudo-random order.

    Ranks are taken within salted parts of a label, so that a label of a third of all rows is not
    one task's window; each part gives its own share.
    """
    salt = F.pmod(F.col(key), F.lit(8))
    rank = F.row_number().over(Window.partitionBy(label, salt).orderBy(lcg(F.col(key)), key))
    size = F.count("*").over(Window.partitionBy(label, salt))
    return rows.withColumn("held_out", rank <= F.ceil(size * F.lit(share)))
