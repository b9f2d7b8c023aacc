"""Golden cells against predicted cells: the three-state join and confusion counts.

Long tables: ``goldens(doc_class, doc, doc_ord, field, field_ord, state, value_json)`` and
``predictions(doc_class, doc, repeat, field, value_json, confidence)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_form, wildcard
from ..functions.values import DEFAULT_CONFIDENCE, equal_values, json_string, normal_container, predicted_state

KEY = ["doc_class", "doc", "field"]


def join_cells(goldens: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every golden cell with what was predicted for it; predictions for other fields are not looked at."""
    found = predictions.select(*KEY, "value_json", "confidence", F.lit(True).alias("found")).withColumnRenamed("value_json", "pred_json")
    rows = goldens.withColumnRenamed("state", "gold_state").withColumnRenamed("value_json", "gold_json").join(found, KEY, "left")
    return rows.withColumn("pred_state", predicted_state(F.col("found"), F.col("pred_json"))).withColumn(
        "confidence", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))
    )


def with_rules(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``kind`` from ``rules(doc_class, pattern, kind)``; null where no rule speaks of the field."""
    named = rules.select("doc_class", F.col("pattern").alias("_pattern"), "kind")
    out = cells.withColumn("_pattern", wildcard(F.col("field")))
    # a rule table has a few rows a class; Spark broadcasts it when its size is known to be small
    return out.join(named, ["doc_class", "_pattern"], "left").drop("_pattern")


def _form(kind: Column, value_json: Column) -> Column:
    text = F.coalesce(json_string(value_json), F.when(value_json.rlike("^-?[0-9]"), value_json))
    inside = F.when(value_json.rlike(r"^[\[{]"), normal_container(kind, value_json)).otherwise(value_json)
    return F.when(kind.isNull(), value_json).when(text.isNotNull(), normal_form(kind, text)).otherwise(inside)


def correctness(cells: DataFrame, kind: Column | None = None) -> DataFrame:
    """Adds ``correct``: a present gold needs an equal present value, another gold needs none."""
    alike = equal_values(F.col("pred_json"), F.col("gold_json"))
    # equal values have equal forms, so forms are made only of those that differ
    equal = alike if kind is None else F.when(alike, True).otherwise(F.when(kind.isNull(), False).otherwise(equal_values(_form(kind, F.col("pred_json")), _form(kind, F.col("gold_json")))))
    return cells.withColumn(
        "correct",
        F.when(F.col("gold_state") == "present", (F.col("pred_state") == "present") & equal).otherwise(F.col("pred_state") != "present"),
    )


def confusion(cells: DataFrame) -> DataFrame:
    """Adds ``tp, fp, fn``: a wrong present value is a false positive and a false negative."""
    hit = (F.col("gold_state") == "present") & F.col("correct")
    said, there = F.col("pred_state") == "present", F.col("gold_state") == "present"
    one = lambda c: c.cast("long")
    return cells.withColumns({"tp": one(said & hit), "fp": one(said & ~hit), "fn": one(there & ~(said & hit))})


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; an empty denominator gives 1, and P + R = 0 gives F1 = 0."""
    p = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, F.lit(1.0)).otherwise(tp / (tp + fn))
    return p, r, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def score_table(cells: DataFrame, by: list[str]) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of counted cells, by any columns."""
    sums = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def monotone_faults(forms: DataFrame, by: list[str]) -> DataFrame:
    """Where a normal form tells apart what is equal without it: ``before, one, other``, for each value and group of ``by``.

    ``forms``: a row a value, ``before`` (canonical JSON text, by which values are equal) and ``after``.  A form without such a row can only
    turn wrong cells right, never right ones wrong.  Values meet by classes of equality, not in pairs.
    """
    seen = forms.withColumn("after", F.coalesce("after", F.lit("null"))).groupBy(*by, "before").agg(F.min("after").alias("one"), F.max("after").alias("other"))
    return seen.filter("one <> other")


def dual_columns(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells counted twice, ``column`` strict and normalized, in one pass."""
    ruled = correctness(with_rules(cells, rules)).withColumnRenamed("correct", "_strict")
    ruled = correctness(ruled, F.col("kind")).withColumnRenamed("correct", "_normalized")
    # both verdicts are made before rows are doubled
    sides = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("correct")) for c in ("strict", "normalized")])
    return confusion(ruled.withColumn("_side", F.explode(sides)).select("*", "_side.column", "_side.correct").drop("_side", "_strict", "_normalized"))


def unmatched(goldens: DataFrame, predictions: DataFrame) -> DataFrame:
    """Golden documents without a prediction: an error of scoring."""
    return goldens.select("doc_class", "doc").distinct().join(predictions.select("doc_class", "doc").distinct(), ["doc_class", "doc"], "left_anti")


def unknown_documents(goldens: DataFrame, records: DataFrame) -> DataFrame:
    return records.select("doc_class", "doc").distinct().join(goldens.select("doc_class", "doc").distinct(), ["doc_class", "doc"], "left_anti")


def macro_mean(table: DataFrame, by: list[str], column: str = "f1") -> DataFrame:
    """Equal-weight mean over classes of means over repeats."""
    inner = table.groupBy(*by, "doc_class").agg(F.avg(column).alias("_mean"))
    return inner.groupBy(*by).agg(F.avg("_mean").alias(f"macro_{column}"))


def point_list(cells: DataFrame) -> DataFrame:
    """Calibration points in the order of cells."""
    return cells.select("doc_class", "doc", "doc_ord", "field_ord", "confidence", "correct")
