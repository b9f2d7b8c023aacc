"""Values invented for absent fields: vocabulary, cell means, rates, and what confidence says of them.

``goldens(doc_class, doc, field, state, value_json)``;
``records(doc_class, doc, repeat, availability, fields)`` with
``fields map<string, struct<value_json, confidence>>``, one row per document and repeat.
"Absent" is any state but present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_field, token_form
from ..functions.values import json_string, substantive

#: No class rate below so many absent cells.
CLASS_FLOOR = 20
COMPLETED = "completed"


def vocabulary(goldens: DataFrame) -> DataFrame:
    """``canon, token``: distinct normal forms of the present strings of each canonical field."""
    text = json_string(F.col("value_json"))
    return (
        goldens.filter((F.col("state") == "present") & text.isNotNull())
        .select(canonical_field(F.col("field")).alias("canon"), token_form(text).alias("token"))
        .distinct()
    )


def without_struck(goldens: DataFrame, strikes: DataFrame) -> DataFrame:
    """Goldens without the struck cells; a present cell is never struck."""
    struck = strikes.select("doc_class", "doc", "field").distinct().withColumn("_struck", F.lit(True))
    rows = goldens.join(struck, ["doc_class", "doc", "field"], "left")
    return rows.filter((F.col("state") == "present") | F.col("_struck").isNull()).drop("_struck")


def cell_records(goldens: DataFrame, records: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """One row per golden cell and record of its document, with ``headline`` and ``strict`` (0 or 1).

    A record that isn't completed says nothing: both are 0 and ``usable`` is false.
    """
    cells = goldens.select("doc_class", "doc", "field", "state")
    usable = F.col("availability") == COMPLETED
    rows = cells.join(records, ["doc_class", "doc"]).withColumn("usable", usable)
    rows = rows.withColumn("_hit", F.when(F.col("usable"), F.try_element_at("fields", F.col("field"))))
    rows = rows.withColumn("value_json", F.col("_hit.value_json")).withColumn("confidence", F.col("_hit.confidence"))
    rows = rows.withColumn("found", F.col("_hit").isNotNull()).drop("_hit", "fields")
    words = vocabulary(goldens) if words is None else words
    rows = rows.withColumn("canon", canonical_field(F.col("field"))).withColumn("token", token_form(json_string(F.col("value_json"))))
    rows = rows.join(words.withColumn("known", F.lit(True)), ["canon", "token"], "left").drop("canon", "token")
    rule = lambda r: (F.col("usable") & substantive(F.col("found"), F.col("value_json"), F.col("known"), r)).cast("int")
    return rows.withColumns({"headline": rule("headline"), "strict": rule("strict")}).drop("known")


def cell_means(rows: DataFrame) -> DataFrame:
    """Per cell: means over usable repeats (``headline``, ``strict``; null without any) and over all
    attempted ones, failures counting 0 (``dual``)."""
    used = lambda c: F.avg(F.when(F.col("usable"), F.col(c)).cast("double"))
    return rows.groupBy("doc_class", "doc", "field", "state").agg(
        used("headline").alias("headline"), used("strict").alias("strict"), F.avg(F.col("headline").cast("double")).alias("dual")
    )


def _rate(value: str, where: Column) -> tuple[Column, Column]:
    return F.avg(F.when(where, F.col(value))), F.count(F.when(where & F.col(value).isNotNull(), 1))


def rates(means: DataFrame) -> DataFrame:
    """The four rates, over all (doc_class null) and by class; class rates under the floor are null.

    One pass: grouping sets over the cells' means.
    """
    absent, present = F.col("state") != "present", F.col("state") == "present"
    pick = {
        "headline": _rate("headline", absent), "strict": _rate("strict", absent),
        "dual": _rate("dual", absent), "answered": _rate("headline", present),
    }
    columns = [c.alias(n) for k, (m, x) in pick.items() for c, n in ((m, f"{k}_rate"), (x, f"{k}_cells"))]
    out = means.groupingSets([[], [F.col("doc_class")]], F.col("doc_class")).agg(
        *columns,
        F.count(F.when(absent & F.col("headline").isNull(), 1)).alias("excluded_cells"),
        F.grouping("doc_class").alias("pooled"),
    )
    few = (F.col("pooled") == 0) & (F.col("headline_cells") < CLASS_FLOOR)
    return out.withColumn("headline_rate", F.when(~few, F.col("headline_rate")))


def document_sums(means: DataFrame, value: str, where: Column) -> DataFrame:
    """``doc_class, doc, total, n``: all that a pooled mean and its bootstrap need of a document."""
    return (
        means.filter(where & F.col(value).isNotNull())
        .groupBy("doc_class", "doc")
        .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    )


def invention_confidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the arm claims where a field is absent: per cell the mean confidence on its inventions, and the
    points (confidence, correct = abstained); repeats without a confidence are counted, never imputed."""
    absent = rows.filter((F.col("state") != "present") & F.col("usable"))
    cells = (
        absent.filter((F.col("headline") == 1) & F.col("confidence").isNotNull())
        .groupBy("doc_class", "doc", "field")
        .agg(F.avg("confidence").alias("mean_confidence"))
    )
    points = absent.select("doc_class", "doc", "field", "repeat", "confidence", (F.col("headline") == 0).alias("correct"))
    return cells, points


def availability(records: DataFrame, by_repeat: bool = True) -> DataFrame:
    """Attempted, completed and failed records, over all (repeat null) and by repeat."""
    is_ = lambda s: F.count(F.when(F.col("availability") == s, 1))
    sets = [[], [F.col("repeat")]] if by_repeat else [[]]
    return records.groupingSets(sets, F.col("repeat")).agg(
        F.count(F.lit(1)).alias("attempted"), is_(COMPLETED).alias("completed"), is_("transport_failure").alias("transport_failures"),
        is_("contract_failure").alias("contract_failures"), F.try_divide(is_(COMPLETED).cast("double"), F.count(F.lit(1))).alias("availability"),
    )


def instability(signatures: DataFrame) -> DataFrame:
    """``doc_class, doc, repeats, divergent``: repeats that differ from the modal signature (the smallest of the most frequent)."""
    counts = signatures.groupBy("doc_class", "doc", "signature").agg(F.count(F.lit(1)).alias("m"))
    return counts.groupBy("doc_class", "doc").agg(F.sum("m").alias("repeats"), (F.sum("m") - F.max("m")).alias("divergent"), F.min_by("signature", F.struct(-F.col("m"), "signature")).alias("modal"))
