"""From files to results: scoring, the judge, and the calibration reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, calibrate, cells, judge, metrics, simulate
from ..sources import jsonl

ORDER = ["doc_ord", "field_ord"]


class UsageError(ValueError):
    """What the caller asked for can't be done: exit code 2."""


class NoNumber(ValueError):
    """The input allows no number: exit code 3."""


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def score(spark: SparkSession, golden: str | list[str], predictions: str | list[str], normalizers: str | None = None) -> dict:
    """The scores file: corpus metrics, per-document scores, curve and points; a normalized block with rules."""
    goldens, predicted = jsonl.read_goldens(spark, golden), jsonl.read_predictions(spark, predictions)
    # predictions without a class are found by document alone
    bare = predicted.filter("doc_class is null").drop("doc_class").join(goldens.select("doc_class", "doc").distinct(), "doc")
    predicted = predicted.filter("doc_class is not null").unionByName(bare.select(*predicted.columns))
    if (lost := cells.unmatched(goldens, jsonl.read_records(spark, predictions).select(F.coalesce("doc_class", F.lit("")).alias("doc_class"), "doc").join(goldens.select(F.col("doc_class").alias("g"), "doc").distinct(), "doc").select(F.when(F.col("doc_class") == "", F.col("g")).otherwise(F.col("doc_class")).alias("doc_class"), "doc")).orderBy("doc_class", "doc").first()) is not None:
        raise UsageError(f"no prediction for {lost.doc_class}/{lost.doc}")
    joined = cells.join_cells(goldens, predicted)
    out = {"version": 1} | _corpus(cells.confusion(cells.correctness(joined)))
    if normalizers:
        rules = jsonl.read_rules(spark, normalizers)
        other = goldens.select("doc_class").distinct().join(rules.select("doc_class").distinct(), "doc_class", "left_anti").first()
        if other:
            raise UsageError(f"normalizers are not for class {other.doc_class}")
        ruled = cells.with_rules(joined, rules)
        out["normalized"] = _corpus(cells.confusion(cells.correctness(ruled, F.col("kind"))))
    return out


def _corpus(counted: DataFrame) -> dict:
    counted = counted.cache()
    try:
        one = cells.score_table(counted, []).first().asDict()
        points = cells.point_list(counted)
        m = metrics.corpus_metrics(points, [], ORDER).first()
        per = cells.score_table(counted, ["doc_class", "doc"])
        per = per.join(metrics.corpus_metrics(points, ["doc_class", "doc"], ORDER), ["doc_class", "doc"])
        docs = counted.select("doc_class", "doc").distinct().count()
        return {
            "corpus": {"docs": docs, "fields": counted.count()} | one | (m.asDict() if m else {}),
            "documents": sorted(_rows(per), key=lambda r: (r["doc_class"], r["doc"])),
            "riskCoverage": [{"coverage": r.coverage, "error": r.error} for r in metrics.risk_coverage(points, []).orderBy("coverage").collect()],
            "points": [{"confidence": r.confidence, "correct": r.correct} for r in points.orderBy(*ORDER).collect()],
        }
    finally:
        counted.unpersist()


def fabrication(spark: SparkSession, golden: str | list[str], predictions: str | list[str], strikes: str | None = None,
                seed: int = bootstrap.SEED, resamples: int = bootstrap.RESAMPLES) -> dict:
    """The judge's breakout with intervals, and what confidence says of inventions."""
    goldens, records = jsonl.read_goldens(spark, golden), jsonl.read_records(spark, predictions)
    if strikes:
        goldens = judge.without_struck(goldens, jsonl.read_strikes(spark, strikes))
    if (u := cells.unknown_documents(goldens, records).first()) is not None:
        raise UsageError(f"records for unknown document {u.doc_class}/{u.doc}")
    rows = judge.cell_records(goldens, records).cache()
    means = judge.cell_means(rows).join(goldens.groupBy("doc_class", "doc").agg(F.min("doc_ord").alias("doc_ord")), ["doc_class", "doc"]).cache()
    try:
        absent, present = F.col("state") != "present", F.col("state") == "present"

        def interval(value: str, where) -> dict | None:
            sums = judge.document_sums(means, value, where).join(means.select("doc_class", "doc", "doc_ord").distinct(), ["doc_class", "doc"])
            ci = bootstrap.pooled_interval(spark, sums, ["doc_ord"], None, seed, resamples)
            return None if ci is None else {"estimate": ci.estimate, "lo": ci.lo, "hi": ci.hi, "cells": int(sums.agg(F.sum("n")).first()[0])}

        table = {r.doc_class: r for r in judge.rates(means.drop("doc_ord")).collect()}
        per_class = []
        for c in sorted(k for k in table if k is not None):
            n = table[c].headline_cells
            per_class.append({"docClass": c, "absentCells": n} | ({"rate": interval("headline", absent & (F.col("doc_class") == c))} if n >= judge.CLASS_FLOOR else {}))
        cells_, points = judge.invention_confidence(rows)
        named = cells_.groupBy("doc_class", "doc").agg(F.sum("mean_confidence").alias("total"), F.count(F.lit(1)).alias("n"))
        kick = bootstrap.pooled_interval(spark, named, ["doc_class", "doc"], None, seed, resamples)
        known = points.filter("confidence is not null")
        a = judge.availability(records, by_repeat=False).first()
        return {
            "pooled": interval("headline", absent), "strict": interval("strict", absent), "dual": interval("dual", absent), "answered": interval("headline", present),
            "availability": {"attempted": a.attempted, "completed": a.completed, "availability": a.availability},
            "perClass": per_class, "excludedAbsentCells": table[None].excluded_cells if None in table else 0,
            "kicker": {
                "meanConfidence": None if kick is None else vars(kick), "points": known.count(), "pointsWithoutConfidence": points.count() - known.count(),
                "riskCoverage": [{"coverage": r.coverage, "error": r.error} for r in metrics.risk_coverage(known, []).orderBy("coverage").collect()],
            },
        }
    finally:
        rows.unpersist()
        means.unpersist()


def reliability(spark: SparkSession, scores: str, sims: int = 1000) -> tuple[list[dict], list[dict]]:
    """Bins of a scores file's points and the ranges that calibrated ones would show; empty without points."""
    points = jsonl.read_points(spark, scores)
    if points.isEmpty():
        return [], []
    bands = _rows(simulate.consistency_bands(points, ["ord"], bootstrap.SEED, sims).orderBy("bin"))
    return bands, bands


def calibration(spark: SparkSession, scores: str, max_error: float = 0.05) -> dict:
    """Platt fit, metrics before and after, and the selective threshold on calibrated confidences."""
    points = jsonl.read_points(spark, scores)
    if why := calibrate.degenerate(points):
        raise NoNumber(why)
    a, b = calibrate.fit_platt(points)
    after = calibrate.apply_platt(points, a, b)
    tau = calibrate_threshold(after, max_error)
    show = lambda p: metrics.corpus_metrics(p, [], ["ord"]).first().asDict()
    return {"a": a, "b": b, "before": show(points), "after": show(after), "selective": tau, "reliability": _rows(metrics.reliability(after, [], ["ord"]).orderBy("bin"))}


def calibrate_threshold(points: DataFrame, max_error: float) -> dict | None:
    best = metrics.selective_threshold(points, [], max_error).first()
    return None if best is None or best.coverage is None else best.asDict()


def curves(spark: SparkSession, variants: dict[str, str], full: str) -> list[dict]:
    """Ablation rows of variants' scores files against the full one."""
    if full not in variants:
        raise UsageError(f"no variant {full}")
    rows = None
    for name, path in variants.items():
        part = jsonl.read_points(spark, path).withColumn("variant", F.lit(name))
        if why := calibrate.degenerate(part):
            raise NoNumber(f"{name}: {why}")
        rows = part if rows is None else rows.unionByName(part)
    return sorted(_rows(calibrate.ablation(rows, full, ["ord"])), key=lambda r: r["variant"])


def gate(spark: SparkSession, scores: str, min_f1: float, max_ece: float, baseline: str | None = None, eps_f1: float = 0.005, eps_ece: float = 0.005) -> dict:
    if not all(calibrate.finite(x) for x in (min_f1, max_ece, eps_f1, eps_ece)):
        raise UsageError("thresholds must be numbers")
    now = jsonl.read_scores(spark, scores).select("corpus.f1", "corpus.ece")
    none = spark.createDataFrame([(None, None)], "base_f1 double, base_ece double")
    base = none if baseline is None else jsonl.read_scores(spark, baseline).select(F.col("corpus.f1").alias("base_f1"), F.col("corpus.ece").alias("base_ece"))
    return calibrate.gate(now.crossJoin(base), min_f1, max_ece, eps_f1, eps_ece).first().asDict()  # one row each
