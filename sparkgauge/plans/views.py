"""Evaluation views over the driver's tables, as DataFrames and as DuckDB CTEs of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration points from line items."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_linestatus").alias("cls"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ln"),
        (F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") == "N").alias("correct"),
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    keys = [F.col("event_type").alias("doc_class"), F.col("user_id").alias("doc"), (F.col("event_id") % 7).alias("fno"), (F.col("event_id") % 3 + 1).cast("int").alias("repeat")]
    return e.groupBy(*keys).agg(F.max("event_id").alias("eid"), F.max("value").alias("v"))


def _field() -> F.Column:
    return F.concat(F.lit("/items/"), F.col("fno").cast("string"), F.lit("/v"))


def _gold_value() -> F.Column:
    return F.concat(F.lit('"'), ((F.col("doc") * 7 + F.col("fno")) % 50).cast("string"), F.lit('"'))


def goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cells from events: a fifth missing, a fifth null, the rest present."""
    b = base(spark, sf_dir).select("doc_class", "doc", "fno").distinct()
    k = (F.col("doc") + F.col("fno")) % 5
    state = F.when(k == 0, "missing").when(k == 1, "null").otherwise("present")
    return b.select(
        "doc_class", "doc", F.col("doc").alias("doc_ord"), _field().alias("field"), F.col("fno").alias("field_ord"), state.alias("state"),
        F.when(k > 1, _gold_value()).alias("value_json"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted cells from events, by repeat: null, blank, an abstention token, right and other values; some keys omitted."""
    b = base(spark, sf_dir).filter(F.col("eid") % 11 != 0)
    k = F.col("eid") % 6
    value = F.when(k == 0, "null").when(k == 1, '""').when(k == 2, '"N/A"').when(k == 3, _gold_value()).otherwise(F.concat(F.lit('"'), F.floor("v").cast("string"), F.lit('"')))
    return b.select("doc_class", "doc", "repeat", _field().alias("field"), value.alias("value_json"), ((F.col("eid") % 101) / 100.0).alias("confidence"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, one a document and repeat, with their fields as a map."""
    units = base(spark, sf_dir).select("doc_class", "doc", "repeat").distinct()
    k = (F.col("doc") * 3 + F.col("repeat")) % 20
    state = F.when(k == 0, "contract_failure").when(k == 1, "transport_failure").otherwise("completed")
    entry = F.struct("field", F.struct("value_json", "confidence"))
    fields = predictions(spark, sf_dir).groupBy("doc_class", "doc", "repeat").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))
    none = F.expr("cast(map() as map<string, struct<value_json: string, confidence: double>>)")
    return units.join(fields, ["doc_class", "doc", "repeat"], "left").withColumn("fields", F.coalesce("fields", none)).withColumn("availability", state)


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goldens(spark, sf_dir).filter((F.col("doc") * 5 + F.col("field_ord")) % 13 == 0).select("doc_class", "doc", "field", F.lit("visible").alias("reason"))


#: The same in DuckDB's SQL.
POINTS = """points AS (
  SELECT l_linestatus AS cls, l_orderkey AS doc, l_linenumber AS ln, l_discount * 10 AS confidence, l_returnflag = 'N' AS correct FROM lineitem)"""
CELLS = """base AS (
  SELECT event_type AS doc_class, user_id AS doc, event_id % 7 AS fno, CAST(event_id % 3 + 1 AS INTEGER) AS repeat, max(event_id) AS eid, max(value) AS v
  FROM events GROUP BY ALL),
goldens AS (
  SELECT DISTINCT doc_class, doc, doc AS doc_ord, '/items/' || fno || '/v' AS field, fno AS field_ord,
    CASE (doc + fno) % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' ELSE 'present' END AS state,
    CASE WHEN (doc + fno) % 5 > 1 THEN '"' || ((doc * 7 + fno) % 50) || '"' END AS value_json
  FROM base),
predictions AS (
  SELECT doc_class, doc, repeat, '/items/' || fno || '/v' AS field,
    CASE eid % 6 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN '"N/A"' WHEN 3 THEN '"' || ((doc * 7 + fno) % 50) || '"'
      ELSE '"' || CAST(floor(v) AS BIGINT) || '"' END AS value_json, (eid % 101) / 100.0::DOUBLE AS confidence
  FROM base WHERE eid % 11 <> 0),
records AS (
  SELECT DISTINCT doc_class, doc, repeat,
    CASE (doc * 3 + repeat) % 20 WHEN 0 THEN 'contract_failure' WHEN 1 THEN 'transport_failure' ELSE 'completed' END AS availability
  FROM base),
strikes AS (SELECT doc_class, doc, field, 'visible' AS reason FROM goldens WHERE (doc * 5 + field_ord) % 13 = 0)"""
#: Cells of each record with the judge's verdicts.
JUDGED = CELLS + """,
vocabulary AS (
  SELECT DISTINCT regexp_replace(field, '/[0-9]+', '/*', 'g') AS canon, lower(trim(value_json, '"')) AS token
  FROM goldens WHERE state = 'present'),
judged AS (
  SELECT g.doc_class, g.doc, g.field, g.state, r.repeat, r.availability, r.availability = 'completed' AS usable,
    CASE WHEN r.availability = 'completed' THEN p.value_json END AS value_json,
    CASE WHEN r.availability = 'completed' THEN p.confidence END AS confidence,
    r.availability = 'completed' AND p.field IS NOT NULL AS found
  FROM goldens g JOIN records r USING (doc_class, doc) LEFT JOIN predictions p USING (doc_class, doc, repeat, field)),
verdicts AS (
  SELECT j.*, CAST(usable AND found AND value_json <> 'null' AS INTEGER) AS strict,
    CAST(coalesce(usable AND found AND value_json <> 'null' AND trim(value_json, '"') <> '' AND NOT (
      lower(trim(value_json, '"')) IN ('n/a', 'not present', 'not applicable', 'none', 'unknown') AND w.token IS NULL), false) AS INTEGER) AS headline
  FROM judged j LEFT JOIN vocabulary w ON w.canon = regexp_replace(j.field, '/[0-9]+', '/*', 'g') AND w.token = lower(trim(j.value_json, '"'))),
means AS (
  SELECT doc_class, doc, field, state, avg(CASE WHEN usable THEN headline END) AS headline, avg(CASE WHEN usable THEN strict END) AS strict, avg(headline) AS dual
  FROM verdicts GROUP BY ALL)"""
