"""What a run's log says: streaks and breaker, observed versions, publication gaps, health, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import judge
from .order import runs


def streaks(records: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``streak``: contract failures in a row up to this record; anything else resets it.  A log may be as long as it likes."""
    return runs(records, by, order, F.col("availability") == "contract_failure", "streak")


def trips(records: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The first record of each arm at which the breaker opens."""
    at = streaks(records, by, order).filter(F.col("streak") >= limit)
    return at.groupBy(*by).agg(F.min(F.struct(*order, "streak")).alias("first")).select(*by, "first.*")


def trailing_streak(records: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Contract failures at the end of each log: records after the last one that is none."""
    place = F.struct(*order)
    last = records.filter("availability <> 'contract_failure'").groupBy(*by).agg(F.max(place).alias("_last"))
    rows = records.join(last, by, "left")
    return rows.groupBy(*by).agg(F.count(F.when(F.col("_last").isNull() | (place > F.col("_last")), 1)).alias("trailing"))


def observed(records: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``values, missing, status`` of a provenance key: not surfaced, surfaced alike everywhere, or mixed."""
    out = records.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("values"), F.count(F.when(value.isNull(), 1)).alias("missing"))
    n = F.size("values")
    return out.withColumn("status", F.when(n == 0, "not_surfaced").when((n == 1) & (F.col("missing") == 0), "surfaced").otherwise("mixed"))


def health(records: DataFrame, planned: int, limit: int, order: list[str]) -> dict:
    rows = judge.availability(records).collect()  # a row a repeat
    tail = trailing_streak(records.withColumn("_all", F.lit(1)), ["_all"], order).first()
    whole = next(r.asDict() for r in rows if r.repeat is None)
    streak = tail.trailing if tail else 0
    status = "paused" if streak >= limit else "complete" if whole["attempted"] == planned else "running"
    return {
        "version": 1, "unit": "doc-repeat", "status": status, "planned": planned, "aggregate": whole,
        "repeats": sorted((r.asDict() for r in rows if r.repeat is not None), key=lambda r: r["repeat"]),
        "consecutiveContractFailures": streak, "contractFailureLimit": limit,
    }


#: Fields that a publishable run's metadata must have.
REQUIRED = ("adapter", "codeState", "goldenSha256", "startedAt", "completedAt", "spend")


def publication_gaps(meta: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``cell, missing``: one row for each required field that a run's metadata lacks."""
    names = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return meta.select("cell", F.explode(names).alias("missing"))


def publication_problems(cells: DataFrame, gaps: DataFrame) -> DataFrame:
    """Why a matrix can't be published: incomplete cells, gaps, more than one commit."""
    incomplete = cells.filter("status <> 'complete'").select(F.concat(F.lit("incomplete: "), "cell").alias("problem"))
    missing = gaps.select(F.concat("cell", F.lit(" lacks "), "missing").alias("problem"))
    commits = cells.agg(F.count_distinct("commit").alias("n")).filter("n > 1").select(F.concat(F.col("n").cast("string"), F.lit(" commits")).alias("problem"))
    return incomplete.unionByName(missing).unionByName(commits)


def costs(cells: DataFrame, meta: DataFrame, manifests: DataFrame, health_rows: DataFrame) -> DataFrame:
    """Cost rows, a cell each; whatever side lacks a cell is null."""
    return cells.join(meta, "cell", "left").join(manifests, "cell", "left").join(health_rows, "cell", "left")


def spend_left(planned: int, restored: int, usd_per_unit: float) -> float:
    """Expected spend of what is left to run."""
    return max(0, planned - restored) * usd_per_unit
