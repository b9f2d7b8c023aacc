"""Scans of JSON Lines and JSON files into long tables, failing closed.

Files are read as splittable text.  Validation is a column; if any row has a fault, the
smallest (file, line) of one is looked up and raised before any result is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


class InputError(ValueError):
    """A file that can't be used; the message names file, line and fault."""


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, ord, value``: non-blank lines; ``ord`` grows with files and lines."""
    rows = spark.read.text(paths if isinstance(paths, list) else [paths])
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value").filter(F.trim("value") != "")


def _check(rows: DataFrame, what: str) -> None:
    """Raise for the first row with a ``fault``; its line number is found only then."""
    bad = rows.filter(F.col("fault").isNotNull()).orderBy("file", "ord").select("file", "value", "fault").first()
    if bad is None:
        return
    spark = rows.sparkSession
    whole = spark.read.text(bad.file, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    at = whole.filter(F.col("line") == bad.value).agg(F.min("n")).first()[0]
    raise InputError(f"{what} {bad.file}:{(at or 0) + 1}: {bad.fault}")


def _parse(rows: DataFrame, schema: str) -> DataFrame:
    # a broken line parses to null rather than failing the scan
    return rows.withColumn("raw", F.try_parse_json("value")).withColumn(
        "j", F.when(F.schema_of_variant(F.col("raw")).startswith("OBJECT"), F.from_json("value", schema))
    )


def _is_text(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("raw"), path, "variant")) == "STRING", F.lit(False))


def golden_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, ord, doc_class, doc, schema, fields``: a row a line, as the files have them; the first line with a fault is raised."""
    rows = _parse(lines(spark, paths), schemas.GOLDEN_LINE)
    j = F.col("j")
    cells = F.map_entries(j["fields"])
    kind = F.schema_of_variant(F.try_variant_get(F.col("raw"), "$.fields", "variant"))
    bad_state = F.exists(cells, lambda c: c["value"].isNull() | ~F.coalesce(c["value"]["state"].isin(*schemas.STATES), F.lit(False)))
    bad_value = F.exists(cells, lambda c: (c["value"]["state"] == "present") != c["value"]["value"].isNotNull())
    fault = (
        F.when(F.col("raw").isNull(), F.lit("invalid JSON"))
        .when(j.isNull(), F.lit("row is not an object"))
        .when(~_is_text("$.doc") | (F.coalesce(j["doc"], F.lit("")) == ""), F.lit("missing doc"))
        .when(~_is_text("$.docClass") | (F.coalesce(j["docClass"], F.lit("")) == ""), F.lit("missing docClass"))
        .when(F.try_variant_get(F.col("raw"), "$.schema", "variant").isNotNull() & ~_is_text("$.schema"), F.lit("schema is not a string"))
        .when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.lit("fields is not an object"))
        .when(bad_state, F.lit("unknown state"))
        .when(bad_value, F.lit("value and state disagree"))
    )
    rows = rows.withColumn("fault", fault)
    _check(rows, "golden")
    return rows.select("file", "ord", j["docClass"].alias("doc_class"), j["doc"].alias("doc"), j["schema"].alias("schema"), j["fields"].alias("fields"))


def read_goldens(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``doc_class, doc, doc_ord, field, field_ord, state, value_json``; ``doc_ord`` orders documents as the files do."""
    good = golden_rows(spark, paths).withColumnRenamed("ord", "doc_ord")
    twice = good.groupBy("doc_class", "doc").count().filter("count > 1").first()
    if twice:
        raise InputError(f"golden: {twice.doc_class}/{twice.doc} appears {twice['count']} times")
    if good.isEmpty():
        raise InputError("golden: no rows")
    return good.select("doc_class", "doc", "doc_ord", F.posexplode("fields").alias("field_ord", "field", "cell")).select(
        "doc_class", "doc", "doc_ord", "field", "field_ord", "cell.state", F.to_json("cell.value").alias("value_json")
    )


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Prediction records, one a document and repeat, other kinds of lines left out:
    ``doc_class, doc, repeat, availability, request_attempts, transport_retries, error, provenance, fields, ord``."""
    rows = _parse(lines(spark, paths), schemas.PREDICTION_LINE)
    j = F.col("j")
    kind = F.schema_of_variant(F.try_variant_get(F.col("raw"), "$.fields", "variant"))
    ours = F.coalesce(j["kind"], F.lit("prediction")) == "prediction"
    fault = (
        F.when(F.col("raw").isNull(), F.lit("invalid JSON"))
        .when(j.isNull(), F.lit("row is not an object"))
        .when(ours & (~_is_text("$.doc") | (F.coalesce(j["doc"], F.lit("")) == "")), F.lit("missing doc"))
        .when(ours & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.lit("fields is not an object"))
        .when(ours & ~F.coalesce(j["availability"], F.lit("completed")).isin(*schemas.AVAILABILITY), F.lit("unknown availability"))
    )
    rows = rows.withColumn("fault", fault)
    _check(rows, "prediction")
    fields = F.transform_values(j["fields"], lambda _, v: F.struct(F.to_json(v["value"]).alias("value_json"), v["confidence"].alias("confidence")))
    return rows.filter(ours).select(
        j["docClass"].alias("doc_class"), j["doc"].alias("doc"), F.coalesce(j["repeat"], F.lit(1)).alias("repeat"),
        F.coalesce(j["availability"], F.lit("completed")).alias("availability"), F.coalesce(j["requestAttempts"], F.lit(1)).alias("request_attempts"),
        F.coalesce(j["transportRetries"], F.lit(0)).alias("transport_retries"), j["error"].alias("error"), j["provenance"].alias("provenance"),
        fields.alias("fields"), "ord",
    )


def read_predictions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """For scoring: ``doc_class, doc, field, value_json, confidence``; an identity may appear once."""
    records = read_records(spark, paths)
    twice = records.groupBy("doc_class", "doc").count().filter("count > 1").first()
    if twice:
        raise InputError(f"prediction: {twice.doc_class}/{twice.doc} appears {twice['count']} times")
    return records.select("doc_class", "doc", F.explode("fields").alias("field", "cell")).select("doc_class", "doc", "field", "cell.value_json", "cell.confidence")


def read_strikes(spark: SparkSession, path: str) -> DataFrame:
    """``doc_class, doc, field, reason, page, seen``."""
    rows = spark.read.schema(schemas.STRIKES_FILE).json(path, multiLine=True)
    if rows.filter(F.col("struck").isNull()).first():
        raise InputError(f"strikes {path}: struck is not an array")
    return rows.select(F.explode("struck").alias("s")).select(F.col("s.docClass").alias("doc_class"), "s.doc", "s.field", "s.reason", "s.page", "s.seen")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Normaliser rules ``doc_class, pattern, kind``."""
    rows = spark.read.schema(schemas.NORMALIZER_FILE).json(path, multiLine=True)
    rules = rows.select(F.col("docClass").alias("doc_class"), F.explode("normalizers").alias("pattern", "kind"))
    fault = (
        F.when(~F.col("kind").isin(*schemas.NORMALIZER_KINDS), F.lit("unknown kind"))
        .when(~F.col("pattern").startswith("/"), F.lit("key without a slash"))
        .when(F.exists(F.split("pattern", "/"), lambda t: t.rlike("^[0-9]+$")), F.lit("numeric token in a key"))
    )
    bad = rules.withColumn("fault", fault).filter("fault is not null").first()
    if bad:
        raise InputError(f"normalizers {path}: {bad.pattern}: {bad.fault}")
    return rules


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The scores file; version 1 with finite F1 and ECE is asked for."""
    rows = spark.read.schema(schemas.SCORES_FILE).json(path, multiLine=True)
    fine = (F.col("version") == 1) & F.col("corpus.f1").isNotNull() & F.col("corpus.ece").isNotNull() & ~F.isnan("corpus.f1") & ~F.isnan("corpus.ece")
    if rows.filter(F.coalesce(fine, F.lit(False))).isEmpty():
        raise InputError(f"scores {path}: version 1 with finite f1 and ece is needed")
    return rows


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``ord, confidence, correct`` of a scores file; none if it has no points."""
    rows = spark.read.schema(schemas.SCORES_FILE).json(path, multiLine=True).select(F.posexplode("points").alias("ord", "p"))
    out = rows.select("ord", "p.confidence", "p.correct")
    bad = out.filter(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) | F.col("correct").isNull()).orderBy("ord").first()
    if bad:
        raise InputError(f"points {path}: point {bad.ord} is not usable")
    return out


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Markdown audit table: ``line, doc_class, doc, field, note, visible``."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    cells = F.transform(F.split("text", "\\|"), lambda c: F.trim(c))
    rows = rows.withColumn("c", cells).filter((F.size("c") == 9) & ~F.col("c")[1].rlike("^(-+|:?-+:?)$"))
    head = rows.agg(F.min("line")).first()[0]
    return rows.filter(F.col("line") != F.lit(head)).select(
        "line", F.col("c")[1].alias("doc_class"), F.col("c")[2].alias("doc"), F.col("c")[3].alias("field"), F.col("c")[4].alias("note"), (F.lower(F.col("c")[7]) == "y").alias("visible")
    )


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Document bytes: ``doc, content, length, sha256``."""
    return spark.read.format("binaryFile").load(pattern).select(
        F.element_at(F.split("path", "/"), -1).alias("doc"), "content", "length", F.sha2("content", 256).alias("sha256")
    )
