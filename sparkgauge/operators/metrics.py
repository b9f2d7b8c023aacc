"""Calibration metrics over points ``(group columns, order columns, confidence, correct)``.

Bins, ranks and running sums over all points of a group need its global order.  A window
would put a group into one task.  Ranks come from a sort over the cluster (``numbered_rows``); for curves counts by distinct confidence come
first, and running sums over them go in two levels (``running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import numbered_rows

BINS = 15


#: Confidences fall into so many cells; running sums go over cells first, then inside each.
CELLS = 4096


def _window(by: list[str], *order: Column | str) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def running(counts: DataFrame, by: list[str], names: list[str], descending: bool = False) -> DataFrame:
    """Adds ``run_<name>`` (sum up to and with the row, by confidence) and ``all_<name>`` of each group.

    ``counts`` has a row for each distinct confidence.  A window over a whole group would be one task, so sums of
    cells are run over first (at most CELLS + 1 rows a group) and a cell's rows then only need each other.
    """
    way = lambda c: F.col(c).desc() if descending else F.col(c)
    rows = counts.withColumn("_cell", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))) * CELLS))
    over = _window(by, way("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*by, "_cell").agg(*[F.sum(n).alias("_s_" + n) for n in names])
    for n in names:
        cells = cells.withColumn("_b_" + n, F.coalesce(F.sum("_s_" + n).over(over), F.lit(0)))
    for n in names:
        cells = cells.withColumn("all_" + n, F.sum("_s_" + n).over(Window.partitionBy(*by)))
    inside = Window.partitionBy(*by, "_cell").orderBy(way("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(cells, [*by, "_cell"])
    for n in names:
        out = out.withColumn("run_" + n, F.col("_b_" + n) + F.sum(n).over(inside))
    return out.drop("_cell", *["_s_" + n for n in names], *["_b_" + n for n in names])


def ranked(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``r`` (from 0, by confidence then ``order``) and ``n`` within each group; no confidence needs a task of its own."""
    return numbered_rows(points, by, ["confidence", *order]).drop("before")


def binned(points: DataFrame, by: list[str], order: list[str], bins: int = BINS) -> DataFrame:
    """Adds ``bin``: min(bins, n) bins of equal mass in order of confidence, then ``order``."""
    k = F.least(F.lit(bins), F.col("n"))
    return ranked(points, by, order).withColumn("bin", F.floor(((F.col("r") + 1) * k - 1) / F.col("n")))


def reliability(points: DataFrame, by: list[str], order: list[str], bins: int = BINS) -> DataFrame:
    """One row a bin: ``bin, bin_n, mean_confidence, accuracy``."""
    return (
        binned(points, by, order, bins)
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("bin_n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    )


def ece(points: DataFrame, by: list[str], order: list[str], bins: int = BINS) -> DataFrame:
    """``ece`` and the debiased ``debiased_ece`` of each group."""
    gap = F.col("accuracy") - F.col("mean_confidence")
    bias = F.when(F.col("bin_n") > 1, F.col("accuracy") * (1 - F.col("accuracy")) / (F.col("bin_n") - 1)).otherwise(0.0)
    total = F.sum("bin_n")
    return (
        reliability(points, by, order, bins)
        .groupBy(*by)
        .agg(
            (F.sum(F.col("bin_n") * F.abs(gap)) / total).alias("ece"),
            F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("bin_n") * (gap * gap - bias)) / total)).alias("debiased_ece"),
        )
    )


def by_confidence(points: DataFrame, by: list[str]) -> DataFrame:
    """Counts by distinct confidence: ``m`` points, ``right`` of them correct."""
    return points.groupBy(*by, "confidence").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("correct").cast("long")).alias("right"))


def brier(points: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("confidence") - F.col("correct").cast("double")
    return points.groupBy(*by).agg(F.avg(d * d).alias("brier"))


def auroc(points: DataFrame, by: list[str]) -> DataFrame:
    """Rank-sum AUROC, half credit for ties; one class only gives 0.5."""
    ranks = running(by_confidence(points, by), by, ["m"]).withColumn("rank", F.col("run_m") - F.col("m") + (F.col("m") + 1) / 2)
    sums = ranks.groupBy(*by).agg(F.sum(F.col("rank") * F.col("right")).alias("s"), F.sum("right").alias("p"), F.sum("m").alias("n"))
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return sums.select(*by, F.when((p == 0) | (q == 0), F.lit(0.5)).otherwise((F.col("s") - p * (p + 1) / 2) / (p * q)).alias("auroc"))


def risk_coverage(points: DataFrame, by: list[str], sentinel: bool = True) -> DataFrame:
    """``coverage, error`` for each distinct confidence from the highest, with ``threshold``; ``sentinel`` adds (0, 0)."""
    steps = running(by_confidence(points, by), by, ["m", "right"], descending=True)
    curve = steps.select(
        *by, F.col("confidence").alias("threshold"), (F.col("run_m") / F.col("all_m")).alias("coverage"), (1 - F.col("run_right") / F.col("run_m")).alias("error")
    )
    if not sentinel:
        return curve
    zero = points.select(*by).distinct() if by else points.limit(1).select()
    return curve.unionByName(zero.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("error")))


def selective_threshold(points: DataFrame, by: list[str], max_error: float) -> DataFrame:
    """The largest coverage whose error is within ``max_error``, and its threshold ``tau``."""
    fit = risk_coverage(points, by, sentinel=False).filter(F.col("error") <= max_error)
    best = fit.groupBy(*by).agg(F.max_by(F.struct("threshold", "coverage", "error"), "coverage").alias("b"))
    return best.select(*by, F.col("b.threshold").alias("tau"), "b.coverage", "b.error")


def error_at_coverage(points: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """Error of the shortest prefix of the curve that covers each of ``grid``."""
    curve = risk_coverage(points, by, sentinel=False).withColumn("target", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    reach = curve.filter(F.col("coverage") >= F.col("target") - 1e-12)
    return reach.groupBy(*by, "target").agg(F.min_by("error", "coverage").alias("error"), F.min("coverage").alias("coverage"))


def coverage_at_error(points: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """Largest coverage with an error within each of ``grid``; 0 where none is."""
    curve = risk_coverage(points, by).withColumn("budget", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return curve.groupBy(*by, "budget").agg(F.max(F.when(F.col("error") <= F.col("budget") + 1e-12, F.col("coverage")).otherwise(0.0)).alias("coverage"))


def corpus_metrics(points: DataFrame, by: list[str], order: list[str], bins: int = BINS) -> DataFrame:
    """ECE, debiased ECE, Brier and AUROC side by side."""
    if by:
        return ece(points, by, order, bins).join(brier(points, by), by).join(auroc(points, by), by)
    return ece(points, by, order, bins).crossJoin(brier(points, by)).crossJoin(auroc(points, by))  # one row each


def confidence_buckets(points: DataFrame, by: list[str], buckets: int = 10) -> DataFrame:
    """Equal-width buckets: ``bucket, n, accuracy, claimed, share`` of the group."""
    b = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col("confidence") * buckets))).cast("int")
    rows = points.groupBy(*by, b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("claimed")
    )
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def tie_groups(intervals: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Of rows with ``estimate, lo, hi``, the best first: ``tied`` while each interval overlaps all before it.

    Rows are results (an arm each), a few for a group.
    """
    order = _window(by, F.col("estimate").desc(), *names)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    overlap = (F.col("lo") <= F.coalesce(F.min("hi").over(before), F.col("lo"))) & (F.col("hi") >= F.coalesce(F.max("lo").over(before), F.col("hi")))
    rows = intervals.withColumn("overlap", overlap)
    return rows.withColumn("tied", F.min("overlap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("overlap")
