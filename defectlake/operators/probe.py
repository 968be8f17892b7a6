"""A probe model on mask features: does a model trained on synthetic samples work on real ones?"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import lcg
from ..plans.planner import holdout
from .report import confusion

TREES, DEPTH, RATE = 50, 3, 0.1


def _assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def _scores(model, rows: DataFrame) -> dict:
    found = model.transform(rows) if model is not None else rows
    r = confusion(found, F.col("label") == 1, F.col("prediction") == 1).first()
    return {k: r[k] for k in ("accuracy", "precision", "recall", "f1")}


def _fit(rows: DataFrame, trees: int):
    return GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=RATE, seed=42).fit(rows)


def _classes(rows: DataFrame) -> dict[int, int]:
    return {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}


def train_probe(synthetic: DataFrame, real: DataFrame | None, names: list[str], trees: int = TREES) -> dict:
    """Cross-validated accuracy on the synthetic rows, scores on the real ones, importances, gap.

    Folds are stratified: rows of a label take the folds in turn, in a hashed order. One class only is
    reported, not raised. The rows are a probe's, which fit one machine.
    """
    counts = _classes(synthetic)
    if len(counts) < 2:
        return {"error": "the synthetic rows have one class"}
    n = sum(counts.values())
    k = min(5, max(2, n // 2), *counts.values())
    if k < 2:
        return {"error": "a class has one row"}
    place = F.row_number().over(Window.partitionBy("label").orderBy(lcg(F.col("id"), 777), "id"))
    folded = _assembled(synthetic, names).withColumn("fold", F.pmod(place, F.lit(k)))
    folded = folded.select("id", "label", "features", "fold").cache()
    right = 0.0
    for fold in range(k):
        train = folded.filter(F.col("fold") != fold)
        test = folded.filter(F.col("fold") == fold)
        m = test.count()
        right += _scores(_fit(train, trees), test)["accuracy"] * m
    model = _fit(folded, trees)
    out = {"cv_accuracy": right / n, "importances": dict(zip(names, map(float, model.featureImportances.toArray()), strict=True))}
    if real is not None:
        out |= {f"real_{a}": v for a, v in _scores(model, _assembled(real, names)).items()}
        out["gap"] = out["cv_accuracy"] - out["real_accuracy"]
    folded.unpersist()
    return out


def compare_baselines(synthetic: DataFrame, real: DataFrame, names: list[str], trees: int = TREES) -> dict:
    """Real only, synthetic only, and both, each scored on a stratified hold-out of the real rows."""
    if real.count() < 4:
        return {"error": "fewer than four real rows"}
    if synthetic.limit(1).count() == 0:
        return {"error": "no synthetic rows"}
    parts = holdout(real).select("id", "label", *names, "held_out").cache()
    test, own = _assembled(parts.filter("held_out"), names), parts.filter("not held_out").select("label", *names)
    both = synthetic.select("label", *names)
    out: dict = {}
    for name, rows in (("real_only", own), ("synthetic_only", both), ("augmented", own.unionAll(both))):
        counts = _classes(rows)
        if len(counts) < 2:
            constant = float(next(iter(counts), 0))
            out[name] = _scores(None, test.withColumn("prediction", F.lit(constant)))
        else:
            out[name] = _scores(_fit(_assembled(rows, names), trees), test)
    out["lift"] = out["augmented"]["f1"] - out["real_only"]["f1"]
    out["is_beneficial"] = out["lift"] > 0
    parts.unpersist()
    return out
