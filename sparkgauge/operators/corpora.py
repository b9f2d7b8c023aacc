"""Golden corpora: schemas from pointers, class builds with their checks, counts.

A build joins three tables of a class: its documents, the goldens they came with, and the frozen goldens of the split.  All
that is wrong is one table of faults over all classes, made before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pointer_tokens
from ..sources.jsonl import InputError
from .adapters import PAGE_CAP


def pointer_conflicts(pointers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pointers that extend a leaf, or that make a node both array and object: ``pointer, fault``, within each group of ``by``."""
    by = by or []
    t = pointers.select(*by, "pointer", pointer_tokens(F.col("pointer")).alias("t")).distinct()
    shape = t.withColumn("form", F.array_join(F.transform("t", lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("*")).otherwise(x)), "\x1f"))
    steps = shape.select(
        *by, "pointer", "form", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.struct(F.slice("t", 1, i).alias("up"), F.get("t", i).alias("key")))).alias("i", "s")
    )
    up = F.array_join(F.transform("s.up", lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("*")).otherwise(x)), "\x1f")
    steps = steps.select(*by, "pointer", up.alias("up"), F.col("s.key").rlike("^[0-9]+$").alias("index"))
    mixed = steps.groupBy(*by, "up").agg(F.min("index").alias("a"), F.max("index").alias("b"), F.max("pointer").alias("pointer")).filter("a <> b")
    inner = steps.filter("up <> ''").select(*by, F.col("up").alias("form"), "pointer")
    leaf = inner.join(shape.select(*by, "form").distinct(), [*by, "form"]).select(*by, "pointer", F.lit("extends a leaf").alias("fault"))
    return leaf.distinct().unionByName(mixed.select(*by, "pointer", F.lit("array and object").alias("fault")))


def nullable_schema(pointers: DataFrame) -> dict:
    """JSON Schema of a class from its distinct pointers; every leaf a nullable string, keys sorted and required."""
    bad = pointer_conflicts(pointers).orderBy("pointer").first()
    if bad:
        raise InputError(f"pointer {bad.pointer}: {bad.fault}")
    root: dict = {}
    for (tokens,) in pointers.select(pointer_tokens(F.col("pointer"))).distinct().collect():  # a class has tens of fields
        node = root
        for t in tokens:
            node = node.setdefault("*" if t.isdigit() else t, {})

    def build(node: dict) -> dict:
        if not node and node is not root:
            return {"type": ["string", "null"]}
        if set(node) == {"*"}:
            return {"type": "array", "items": build(node["*"])}
        return {"type": "object", "properties": {k: build(node[k]) for k in sorted(node)}, "required": sorted(node), "additionalProperties": False}

    return build(root)


def file_name(doc: Column) -> Column:
    """A golden's document as the name of its file."""
    return F.when(F.lower(doc).endswith(".pdf"), doc).otherwise(F.concat(doc, F.lit(".pdf")))


def build_rows(documents: DataFrame, source: DataFrame, frozen: DataFrame) -> DataFrame:
    """One row a class and file name with what the three tables say of it, by one shuffle.

    ``documents``: ``doc_class, doc, pages``; ``source`` and ``frozen``: ``doc_class`` (the folder's), ``doc, row_class`` and ``cells`` (canonical
    text of the fields in their order).
    """
    none = lambda kind: F.lit(None).cast(kind)
    golden = lambda t, side: t.select("doc_class", file_name(F.col("doc")).alias("doc"), F.lit(side).alias("side"), none("int").alias("pages"), F.struct("row_class", "cells", F.lower("doc").endswith(".pdf").alias("named")).alias("g"))
    own = documents.select("doc_class", "doc", F.lit("document").alias("side"), F.col("pages").cast("int").alias("pages"), none("struct<row_class: string, cells: string, named: boolean>").alias("g"))
    every = own.unionByName(golden(source, "source")).unionByName(golden(frozen, "frozen"))
    is_ = lambda side: F.col("side") == side
    return every.groupBy("doc_class", "doc").agg(
        *[F.count(F.when(is_(side), 1)).alias(f"n_{side}") for side in ("document", "source", "frozen")], F.max("pages").alias("pages"),
        F.max(F.when(is_("source"), F.col("g"))).alias("source"), F.max(F.when(is_("frozen"), F.col("g"))).alias("frozen"),
        F.max(F.when(is_("source"), F.col("g.named"))).alias("suffixed"), F.max(F.when(is_("source"), F.col("g.row_class") != F.col("doc_class"))).alias("strange"),
    )


#: What can be wrong with a document, in the order in which it is looked for.
DOCUMENT_FAULTS = (
    ("source row of another class", "coalesce(strange, false)"),
    ("source row names a file", "coalesce(suffixed, false)"),
    ("more than one source row", "n_source > 1"),
    ("more than one frozen row", "n_frozen > 1"),
    ("more than one document", "n_document > 1"),
    ("document without a source row", "n_document > 0 and n_source = 0"),
    ("document without a frozen row", "n_document > 0 and n_frozen = 0"),
    ("frozen row without a document", "n_document = 0 and n_frozen > 0"),
    ("source and frozen rows differ", "n_document = 1 and n_source = 1 and n_frozen = 1 and (source.cells <> frozen.cells or source.row_class <> frozen.row_class)"),
    ("no page count", "n_document > 0 and coalesce(pages, 0) < 1"),
)


def document_faults(built: DataFrame) -> DataFrame:
    """``doc_class, doc, fault``: everything wrong with the rows of ``build_rows``."""
    found = F.array_compact(F.array(*[F.when(F.expr(condition), F.lit(fault)) for fault, condition in DOCUMENT_FAULTS]))
    return built.select("doc_class", "doc", F.explode_outer(found).alias("fault")).filter("fault is not null")


def class_faults(classes: DataFrame, documents: DataFrame, manifests: DataFrame, hashes: DataFrame) -> DataFrame:
    """``doc_class, doc`` (null), ``fault`` of whole classes: ``manifests`` has ``doc_class, named, expected``, ``hashes`` ``doc_class, sha256`` of the frozen goldens."""
    there = documents.select("doc_class").distinct().withColumn("_there", F.lit(True))
    rows = classes.join(there, "doc_class", "left").join(manifests, "doc_class", "left").join(hashes, "doc_class", "left")
    sound = F.coalesce(F.col("named") == F.col("doc_class"), F.lit(False)) & F.col("expected").isNotNull()
    found = F.array_compact(
        F.array(
            F.when(F.col("_there").isNull(), F.lit("no documents")),
            F.when(~sound, F.lit("manifest without the class and its hash")),
            F.when(sound & ~F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)), F.lit("frozen goldens aren't those of the manifest")),
        )
    )
    return rows.select("doc_class", F.lit(None).cast("string").alias("doc"), F.explode_outer(found).alias("fault")).filter("fault is not null")


def field_faults(fields: DataFrame) -> DataFrame:
    """``doc_class, doc, fault`` of pointers (``doc_class, doc, field``): those that are none, and those that disagree within a class."""
    p = F.col("field")
    fault = F.when(p == "", F.lit("pointer to the root")).when(~p.startswith("/"), F.lit("no pointer")).when(p.rlike("~([^01]|$)"), F.lit("pointer with a wrong escape"))
    said = fields.select("doc_class", "doc", "field", fault.alias("fault"))
    wrong = said.filter("fault is not null").select("doc_class", "doc", F.concat_ws(": ", "fault", "field").alias("fault"))
    sound = said.filter("fault is null").select("doc_class", F.col("field").alias("pointer"))
    clash = pointer_conflicts(sound, ["doc_class"]).select("doc_class", F.lit(None).cast("string").alias("doc"), F.concat_ws(": ", "fault", "pointer").alias("fault"))
    return wrong.unionByName(clash)


def corpus_counts(goldens: DataFrame, pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """Per class and over all (doc_class null): documents, fields, absent (missing only) and pages, within the cap and in all."""
    per = goldens.groupBy("doc_class", "doc").agg(F.count(F.lit(1)).alias("fields"), F.count(F.when(F.col("state") == "missing", 1)).alias("absent"))
    return document_sums(per.join(pages, ["doc_class", "doc"]), cap)


def document_sums(rows: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """The same from a row a document (``doc_class, doc, pages, fields, absent``)."""
    small = F.col("pages") <= cap
    sums = [F.sum(F.when(w, c)).alias(f"{n}{s}") for s, w in (("", F.lit(True)), ("_within_cap", small)) for n, c in (("fields", F.col("fields")), ("absent", F.col("absent")), ("pages", F.col("pages")))]
    return rows.groupingSets([[], [F.col("doc_class")]], F.col("doc_class")).agg(F.count(F.lit(1)).alias("docs"), F.count(F.when(small, 1)).alias("docs_within_cap"), *sums)


def page_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_class", "pages").agg(F.count(F.lit(1)).alias("docs"))


def format_schema(value: object, indent: int = 0, width: int = 100) -> str:
    """JSON text with short arrays on one line, as a formatter would leave it."""
    import json

    pad = "  " * indent
    if isinstance(value, dict) and value:
        inner = [f"{pad}  {json.dumps(k)}: {format_schema(v, indent + 1, width)}" for k, v in value.items()]
        return "{\n" + ",\n".join(inner) + f"\n{pad}}}"
    if isinstance(value, list) and value:
        line = json.dumps(value)
        if len(line) + 2 * indent <= width and all(not isinstance(v, (dict, list)) for v in value):
            return line
        return "[\n" + ",\n".join(f"{pad}  {format_schema(v, indent + 1, width)}" for v in value) + f"\n{pad}]"
    return json.dumps(value)
