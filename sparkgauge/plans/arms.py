"""All arms of a matrix side by side: F1 with intervals, fabrication, confidence, price, contrasts with the baseline, noise and detectable effects.

A document counts with the mean of its repeats, and documents are what intervals resample, within their classes.  All intervals of an arm
come from one set of resamples, all contrasts of the table from another.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, cells, metrics, runlog, simulate
from ..operators.bootstrap import RESAMPLES, SEED, Sums
from ..sources import jsonl
from ..sources.store import resolve
from . import matrix, report, score

COLUMNS = ("normalized", "strict")
_CELLS = ("tp", "fp", "fn")


@dataclass(frozen=True)
class Place:
    """A finished matrix and the corpus that it is of."""

    out: Path
    corpora: Path

    def manifest(self) -> dict:
        return json.loads((self.out / "matrix-manifest.json").read_text())

    def golden(self, doc_class: str) -> Path:
        """What primary scores are on: the capped set where there is one."""
        capped = matrix.golden_path(f"golden.{doc_class}.capped.jsonl", self.corpora, self.out)
        return capped if capped.exists() else self.corpora / f"golden.{doc_class}.jsonl"

    def predictions(self, arm: str, doc_class: str) -> list[str]:
        found = sorted(str(p) for p in (self.out / arm / doc_class / "main").glob("predictions.repeat-*.jsonl"))
        if not found:
            raise score.UsageError(f"{self.out / arm / doc_class / 'main'}: no predictions")
        return found


def arm_cells(spark: SparkSession, place: Place, arm: str, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells of an arm: counted twice, ``column`` strict and normalized, with ``repeat``; and its records."""
    goldens = jsonl.read_goldens(spark, [str(place.golden(c)) for c in classes])
    records = jsonl.read_records(spark, [p for c in classes for p in place.predictions(arm, c)])
    rules = None
    for c in classes:
        part = jsonl.read_rules(spark, str(place.corpora / f"normalizers.{c}.json"))
        rules = part if rules is None else rules.unionByName(part)
    repeats = records.select("doc_class", "repeat").distinct()
    unit = F.struct("doc", "repeat")
    g = goldens.join(F.broadcast(repeats), "doc_class").withColumn("doc", unit)  # a row a class and repeat
    p = records.select("doc_class", unit.alias("doc"), F.explode("fields").alias("field", "cell")).select("doc_class", "doc", "field", "cell.value_json", "cell.confidence")
    both = cells.dual_columns(cells.join_cells(g, p), rules)
    return both.withColumn("repeat", F.col("doc.repeat")).withColumn("doc", F.col("doc.doc")), records


def document_means(counted: DataFrame) -> DataFrame:
    """``doc_class, doc`` and, for both columns, ``tp, fp, fn`` as means over repeats."""
    per = counted.groupBy("column", "doc_class", "doc", "repeat").agg(*[F.sum(c).alias(c) for c in _CELLS])
    mean = per.groupBy("column", "doc_class", "doc").agg(*[F.avg(c).alias(c) for c in _CELLS])
    wide = [F.sum(F.when(F.col("column") == k, F.col(c))).alias(f"{k}_{c}") for k in COLUMNS for c in _CELLS]
    return mean.groupBy("doc_class", "doc").agg(*wide)


def f1_intervals(spark: SparkSession, documents: DataFrame, classes: list[str], seed: int = SEED, resamples: int = RESAMPLES) -> dict[str, bootstrap.Interval]:
    """``<column>`` (macro) and ``<column>/<class>`` from one set of resamples."""
    names = [f"{k}_{c}" for k in COLUMNS for c in _CELLS]
    wide, columns = bootstrap.by_class(documents, classes, names)
    closings = {}
    for k in COLUMNS:
        of = lambda i, k=k: (lambda s: bootstrap.pooled_f1(lambda c: s(f"{k}_{c}{i}")))
        closings |= {f"{k}/{c}": of(i) for i, c in enumerate(classes)}

        def macro(s: Sums, k=k):
            each = [bootstrap.pooled_f1(lambda c, i=i: s(f"{k}_{c}{i}")) for i in range(len(classes))]  # noqa: B023
            return sum(each[1:], each[0]) / len(classes)

        closings[k] = macro
    found = bootstrap.resampled(spark, wide, columns, closings, ["doc_class", "doc"], "doc_class", seed, resamples)
    return {name: r.interval() for name, r in found.items()}


def _value(ci: bootstrap.Interval) -> dict:
    return {"estimate": ci.estimate, "lo": ci.lo, "hi": ci.hi}


def confidence(counted: DataFrame, records: DataFrame, asked: bool = True) -> dict:
    """What the arm's confidences are worth; only of an arm that gives some, never made from the default."""
    own = records.select(F.explode(F.map_values("fields")).alias("f")).filter("f.confidence is not null")
    if own.isEmpty():
        return {"kind": "none" if asked else "unasked"}
    points = counted.filter(F.col("column") == "strict").select("doc_class", "doc", "repeat", "doc_ord", "field_ord", "confidence", "correct")
    m = metrics.corpus_metrics(points, [], ["doc_ord", "field_ord", "repeat"]).first()
    at = metrics.error_at_coverage(points, [], [0.9]).first()
    version = runlog.observed(records.withColumn("_all", F.lit(1)), ["_all"], F.col("provenance.calibratorVersion")).first().asDict()
    one = lambda v: None if v is None else {"estimate": v}
    return {"kind": "numeric", "stamp": report.stamp_label(version), "ece": one(m.ece), "brier": one(m.brier), "errorAtCoverage90": one(at.error if at else None)}


def usd_per_1k_pages(place: Place, arm: str, repeats: int) -> float | None:
    """Expected spend of the arm's main pass over the pages that it ran; null without prices or page counts."""
    log, counts = place.out / "cost-log.json", place.corpora / "corpus-counts.json"
    if not log.is_file() or not counts.is_file():
        return None
    own = [c for c in json.loads(log.read_text()) if c["cell"].split("/")[0] == arm and c["cell"].endswith("/main")]
    said = json.loads(counts.read_text())["classes"]
    pages = 0
    for c in own:
        name = c["cell"].split("/")[1]
        ran = {json.loads(x)["doc"] for x in Path(place.predictions(arm, name)[0]).read_text().splitlines()}
        pages += sum(p["pages"] for p in said.get(name, {}).get("pageCounts", []) if p["doc"] in ran)
    usd = [c["expectedUsd"] for c in own]
    return None if not pages or None in usd else 1000 * sum(usd) / (pages * repeats)


def build(spark: SparkSession, out: str, corpora: str, baseline: str | None = None, seed: int = SEED, resamples: int = RESAMPLES, sims: int = 1000) -> dict[str, str]:
    """The tables by file name.  ``baseline`` names the arm that others are held against; without it the first one."""
    place = Place(Path(out), resolve(corpora))
    config = place.manifest()["config"]
    classes, arms = sorted(config["classes"]), [a["id"] for a in config["armModes"]]
    baseline = baseline or arms[0]
    if baseline not in arms:
        raise score.UsageError(f"{baseline} is no arm of the matrix")
    rows, values = [], None
    for arm in arms:
        counted, records = arm_cells(spark, place, arm, classes)
        counted = counted.cache()
        try:
            documents = document_means(counted)
            found = f1_intervals(spark, documents, classes, seed, resamples)
            judged = score.fabrication(spark, [str(place.golden(c)) for c in classes], [p for c in classes for p in place.predictions(arm, c)], None, seed, resamples)
            rows.append({
                "arm": arm, "macroF1": {k: _value(found[k]) for k in COLUMNS}, "perClassF1": {c: {k: _value(found[f"{k}/{c}"]) for k in COLUMNS} for c in classes},
                "fabrication": judged["pooled"], "confidence": confidence(counted, records), "usdPer1kPages": usd_per_1k_pages(place, arm, config["repeats"]),
            })
            f1 = cells.scores(*[F.col(f"normalized_{c}") for c in _CELLS])[2]
            # a number a document and arm: written before the cells go
            own = spark.createDataFrame(documents.select(F.lit(arm).alias("arm"), "doc_class", "doc", f1.alias("value")).toArrow())
            values = own if values is None else values.unionByName(own)
            sizes = counted.filter(F.col("column") == "strict").groupBy("doc_class").agg(F.count_distinct("doc").alias("docs"), F.count_distinct("doc", "field").alias("fields")).collect()
        finally:
            counted.unpersist()
    tables = {"headline.txt": report.headline_table(rows), "accuracy.txt": report.accuracy_table(rows, classes), "confidence.txt": report.confidence_table(rows)}
    if len(arms) > 1:
        tests = bootstrap.contrasts(spark, values, baseline, stratum="doc_class", seed=seed, resamples=resamples).orderBy("ord").collect()
        tables["contrasts.txt"] = report.contrast_table([r.asDict() for r in tests], baseline)
    floor = {r.n: r for r in simulate.noise_floor(spark, sorted({r.fields for r in sizes}), seed, sims).collect()}
    tables["noise.txt"] = report.noise_table([{"label": r.doc_class, "n": r.fields, "mean": floor[r.fields]["mean"], "p05": floor[r.fields].p05, "p95": floor[r.fields].p95} for r in sorted(sizes, key=lambda r: r.doc_class)])
    tables["effects.txt"] = report.effect_table([_effect(spark, r, seed, sims) for r in sorted(sizes, key=lambda r: r.doc_class)], "paired documents, 80 % power, two-sided 5 %, fields of a document correlated")
    return tables


def _effect(spark: SparkSession, size, seed: int, sims: int) -> dict:
    per = [max(1, round(size.fields / size.docs))] * size.docs
    grid = [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.16, 0.2]
    least = lambda base: simulate.detectable_effect(spark, per, base, [d for d in grid if base + d < 1], seed, sims=min(600, sims))["mde"] if size.docs > 1 else None
    return {"class": size.doc_class, "docs": size.docs, "fields": size.fields, "at75": least(0.75), "at90": least(0.9)}
