"""The published dataset: a row per cell and repeat, probes, audit; and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prediction_rows(rows: DataFrame, strikes: DataFrame, arm: str, run_pass: str) -> DataFrame:
    """From ``judge.cell_records``: what was predicted for every cell, and the verdict where it can be judged.

    A verdict is null unless the cell is absent, not struck, and the record completed; strikes count in the main pass.
    """
    struck = strikes.select("doc_class", "doc", "field").distinct().withColumn("_s", F.lit(run_pass == "main"))
    out = rows.join(struck, ["doc_class", "doc", "field"], "left")
    absent = F.col("state") != "present"
    is_struck = F.coalesce(F.col("_s"), F.lit(False)) & absent
    judged = absent & ~is_struck & F.col("usable")
    state = (
        F.when(~F.col("usable"), "failed").when(~F.col("found"), "omitted").when(F.col("value_json") == "null", "null")
        .when(F.col("headline") == 1, "value").otherwise("declined")
    )
    return out.select(
        F.lit(arm).alias("arm"), F.lit(run_pass).alias("pass"), "doc_class", "doc", "repeat", "field", F.col("state").alias("gold_state"), "availability",
        state.alias("predicted_state"), F.when(F.col("found"), F.col("value_json")).alias("value"), "confidence", is_struck.alias("struck"),
        F.when(judged, F.col("headline") == 1).alias("fabricated"), F.when(judged, F.col("strict") == 1).alias("fabricated_strict"),
    )


def probe_rows(probes: DataFrame, struck: DataFrame) -> DataFrame:
    s = struck.select("doc_class", "field").distinct().withColumn("_s", F.lit(True))
    return probes.join(s, ["doc_class", "field"], "left").withColumn("struck", F.coalesce("_s", F.lit(False))).drop("_s")


def audit_rows(goldens: DataFrame, strikes: DataFrame, audited: int | None = None) -> DataFrame:
    """Absent labels with their verdict, a strike's reason or ``confirmed``; their number is checked."""
    absent = goldens.filter("state <> 'present'").select("doc_class", "doc", "field", "state")
    out = absent.join(strikes.select("doc_class", "doc", "field", "reason"), ["doc_class", "doc", "field"], "left").withColumn("verdict", F.coalesce("reason", F.lit("confirmed"))).drop("reason")
    if audited is not None and (n := out.count()) != audited:
        raise ValueError(f"audit: {n} absent cells, {audited} audited")
    return out


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arm", "pass", "doc_class").agg(
        F.count(F.lit(1)).alias("rows"), F.count("fabricated").alias("judged"), F.count(F.when(F.col("fabricated"), 1)).alias("fabricated")
    )
