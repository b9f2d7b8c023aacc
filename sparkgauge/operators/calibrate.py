"""One-dimensional Platt calibration, selective thresholds, ablation curves and the gate."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

#: Fixed values of the fit.
RIDGE = 1e-3
WEIGHT_FLOOR = 1e-6
STEPS = 100
TOLERANCE = 1e-12


def fit_platt(points: DataFrame, ridge: float = RIDGE) -> tuple[float, float]:
    """Slope and intercept of p = logistic(a x + b), ridge on the slope only.

    Each step is a weighted least-squares solve whose five sums are one aggregation over the counts
    by distinct confidence; what reaches the driver are those sums.
    """
    cells = metrics.by_confidence(points, []).select(F.col("confidence").alias("x"), "m", "right").cache()
    try:
        a = b = 0.0
        for _ in range(STEPS):
            eta = F.lit(a) * F.col("x") + F.lit(b)
            mu = logistic(eta)
            w = F.greatest(mu * (1 - mu), F.lit(WEIGHT_FLOOR))
            # m points share x; their working responses add up to m eta + (right - m mu) / w
            wz = w * F.col("m") * eta + F.col("right") - F.col("m") * mu
            wm = w * F.col("m")
            s = cells.agg(F.sum(wm * F.col("x") ** 2), F.sum(wm * F.col("x")), F.sum(wm), F.sum(wz * F.col("x")), F.sum(wz)).first()
            if s[2] is None:
                break
            new = np.linalg.solve([[s[0] + ridge, s[1]], [s[1], s[2]]], [s[3], s[4]])
            move = max(abs(new[0] - a), abs(new[1] - b))
            a, b = float(new[0]), float(new[1])
            if move < TOLERANCE:
                break
        return a, b
    finally:
        cells.unpersist()


def logistic(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def apply_platt(points: DataFrame, a: float, b: float) -> DataFrame:
    return points.withColumn("confidence", logistic(F.lit(a) * F.col("confidence") + F.lit(b)))


def degenerate(points: DataFrame) -> str | None:
    """Why no calibration can be given: no points, one class, or one confidence."""
    s = points.agg(F.count(F.lit(1)), F.min("confidence"), F.max("confidence"), F.min(F.col("correct").cast("int")), F.max(F.col("correct").cast("int"))).first()
    if not s[0]:
        return "no calibration points"
    if s[3] == s[4]:
        return "only one class is present"
    return "all confidences are the same" if s[1] == s[2] else None


def ablation(variants: DataFrame, full: str, order: list[str]) -> DataFrame:
    """Each variant's metrics less those of ``full``; ``degenerate`` where its points are the same.

    ``variants(variant, <order>, confidence, correct)``.
    """
    columns = [*order, "confidence", "correct"]
    others = variants.filter(F.col("variant") != full).select("variant", *columns, F.lit(1).alias("_n"))
    names = variants.filter(F.col("variant") != full).select("variant").distinct()
    base = variants.filter(F.col("variant") == full).select(*columns, F.lit(-1).alias("_n"))
    # the full variant's points against each other's: what doesn't cancel differs; variants are a few
    left = others.unionByName(names.crossJoin(base)).groupBy("variant", *columns).agg(F.sum("_n").alias("_n"))
    same = left.groupBy("variant").agg((F.count(F.when(F.col("_n") != 0, 1)) == 0).alias("degenerate"))
    table = metrics.corpus_metrics(variants, ["variant"], order)
    whole = table.filter(F.col("variant") == full)
    keep = ("ece", "debiased_ece", "brier", "auroc")
    deltas = table.filter(F.col("variant") != full).crossJoin(whole.select(*[F.col(c).alias("_" + c) for c in keep]))  # one row
    return deltas.join(same, "variant").select("variant", "degenerate", *[F.when(~F.col("degenerate"), F.col(c) - F.col("_" + c)).alias("d_" + c) for c in keep])


def gate(scores: DataFrame, min_f1: float, max_ece: float, eps_f1: float = 0.005, eps_ece: float = 0.005) -> DataFrame:
    """Adds what fails of ``f1, ece`` (and ``base_f1, base_ece``, null without a baseline), and ``passed``."""
    fail = {
        "low_f1": F.col("f1") < min_f1, "high_ece": F.col("ece") > max_ece,
        "f1_drop": F.coalesce(F.col("base_f1") - F.col("f1") > eps_f1, F.lit(False)),
        "ece_rise": F.coalesce(F.col("ece") - F.col("base_ece") > eps_ece, F.lit(False)),
    }
    out = scores.withColumns(fail)
    return out.withColumn("passed", ~(F.col("low_f1") | F.col("high_ece") | F.col("f1_drop") | F.col("ece_rise")))


def finite(x: float) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
