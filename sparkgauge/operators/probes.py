"""Planted fields: pools from sibling schemas, seeded draws, probe goldens, worksheets, strikes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import Rng
from ..functions.text import search_tokens
from .order import numbered_rows

PER_CLASS = 3
SEED = 20260712
#: Characters of the tokens that are searched for at once (some 60 bytes each in an automaton).
PATTERN_CHARS = 2_000_000


def leaf_fields(spark: SparkSession, schemas: dict[str, dict]) -> DataFrame:
    """``doc_class, field, leaf``: top-level properties; ``leaf`` if a nullable string."""
    rows = [
        (c, name, isinstance(spec.get("type"), list) and {"string", "null"} <= set(spec["type"]))
        for c, s in schemas.items()
        for name, spec in (s.get("properties") or {}).items()
    ]
    return spark.createDataFrame(rows, "doc_class string, field string, leaf boolean")


def pools(fields: DataFrame) -> DataFrame:
    """``doc_class, field, source_class, at``: leaves of sibling classes that the class doesn't have, the
    first sibling's kept; ``at`` orders the pool by sibling, then field."""
    own = fields.select("doc_class", "field").distinct()
    other = fields.filter("leaf").select(F.col("doc_class").alias("source_class"), "field")
    classes = fields.select("doc_class").distinct()
    # classes against classes: a few rows
    rows = classes.join(other, F.col("doc_class") != F.col("source_class")).join(own, ["doc_class", "field"], "left_anti")
    first = rows.groupBy("doc_class", "field").agg(F.min("source_class").alias("source_class"))
    ordered = first.groupBy("doc_class").agg(F.array_sort(F.collect_list(F.struct("source_class", "field"))).alias("p"))
    return ordered.select("doc_class", F.posexplode("p").alias("at", "c")).select("doc_class", "c.field", "c.source_class", "at")


def draw(pool: DataFrame, seed: int = SEED, per_class: int = PER_CLASS) -> dict[str, list[tuple[str, str]]]:
    """Draws without replacement, one stream over all classes in order; a short pool is an error."""
    rng, out, held = Rng(seed), {}, {}
    for r in pool.orderBy("doc_class", "at").collect():  # a pool holds the fields of a few schemas
        held.setdefault(r.doc_class, []).append((r.field, r.source_class))
    for c in sorted(held):
        if len(held[c]) < per_class:
            raise ValueError(f"probes: the pool of {c} has {len(held[c])} fields")
        left = list(held[c])
        out[c] = [left.pop(rng.int(len(left))) for _ in range(per_class)]
    return out


def probe_schema(schema: dict, probes: list[tuple[str, str]]) -> dict:
    """The class schema with each probe as a nullable, required leaf."""
    return schema | {
        "properties": (schema.get("properties") or {}) | {f: {"type": ["string", "null"]} for f, _ in probes},
        "required": [*schema.get("required", []), *[f for f, _ in probes]],
    }


def probe_goldens(documents: DataFrame, probes: DataFrame) -> DataFrame:
    """Every document of a class against its probes, all ``missing``."""
    return documents.select("doc_class", "doc").distinct().join(probes.select("doc_class", F.concat(F.lit("/"), "field").alias("field")), "doc_class").select(
        "doc_class", "doc", "field", F.lit("missing").alias("state"), F.lit(None).cast("string").alias("value_json")
    )


def _patterns(fields: DataFrame, most: int) -> Iterator[list[tuple[str, str, list[str]]]]:
    """The fields (``doc_class, field``) with their tokens, in lots of at most ``most`` characters (one field at least)."""
    rows = fields.select("doc_class", "field").distinct().withColumn("tokens", search_tokens(F.col("field")))
    size = rows.agg(F.sum(F.aggregate("tokens", F.lit(0), lambda a, t: a + F.length(t)))).first()[0] or 0
    lots = max(1, -(-2 * size // most)) if size > most else 1
    for lot in range(lots):
        found = rows.filter(F.pmod(F.xxhash64("doc_class", "field"), F.lit(lots)) == lot).collect()
        if found:
            yield [(r.doc_class, r.field, list(r.tokens)) for r in found]


class Finder:
    """Which fields a text names: one automaton over the tokens of all fields, so a text is read once however many there are."""

    def __init__(self, fields: list[tuple[str, str, list[str]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        named: dict[str, list[tuple[str, str, int, str]]] = {}
        # every text holds the empty token
        self.always = [(c, f, i, t) for c, f, tokens in fields for i, t in enumerate(tokens) if not t]
        for c, f, tokens in fields:
            for i, t in enumerate(tokens):
                if t:
                    named.setdefault(t.lower(), []).append((c, f, i, t))
        for token, own in named.items():
            self.automaton.add_word(token, own)
        self.any = bool(named)
        if self.any:
            self.automaton.make_automaton()

    def found(self, doc_class: str, text: str) -> dict[str, str]:
        """The first of its tokens for each field of the class that the text names."""
        hits = {id(own): own for _, own in self.automaton.iter(text.lower())} if self.any else {}
        best: dict[str, tuple[int, str]] = {}
        for c, f, i, t in [*self.always, *(x for own in hits.values() for x in own)]:
            if c == doc_class and (f not in best or i < best[f][0]):
                best[f] = (i, t)
        return {f: t for f, (_, t) in sorted(best.items())}


def text_hits(texts: DataFrame, probes: DataFrame, most: int = PATTERN_CHARS) -> DataFrame:
    """Probes that a document's own text names: ``doc_class, doc, field, token``.

    Texts are read once for each lot of fields; a lot's tokens have at most ``most`` characters, which bounds what is sent.  Null texts name nothing.
    """
    kind = dict(texts.dtypes)["doc"]
    out = None
    for lot in _patterns(probes, most):
        sent = texts.sparkSession.sparkContext.broadcast(lot)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value)
            for batch in batches:
                at, fields, tokens = [], [], []
                for i, (c, text) in enumerate(zip(batch.column("doc_class"), batch.column("text"), strict=True)):
                    if text.is_valid and c.is_valid:
                        for f, t in finder.found(c.as_py(), text.as_py()).items():
                            at.append(i)
                            fields.append(f)
                            tokens.append(t)
                own = batch.select(["doc_class", "doc"]).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(fields, pa.string()), pa.array(tokens, pa.string())], names=["doc_class", "doc", "field", "token"])

        found = texts.select("doc_class", "doc", "text").mapInArrow(run, f"doc_class string, doc {kind}, field string, token string")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.select("doc_class", "doc", F.lit("").alias("field"), F.lit("").alias("token")).limit(0)
    return out


def strikes(worksheet: DataFrame) -> DataFrame:
    """Fields seen in a document: ``doc_class, field, documents`` in worksheet order."""
    return (
        worksheet.filter("visible")
        .groupBy("doc_class", "field")
        .agg(F.array_sort(F.collect_list(F.struct("line", "doc"))).alias("s"))
        .select("doc_class", "field", F.col("s.doc").alias("documents"))
    )


#: Collation of names: letters before case and accents, as people sort.
COLLATION = "UNICODE"


def in_order(struck: DataFrame, place: str) -> DataFrame:
    """Adds ``place``: where a strike stands when classes, then fields, are sorted as people sort names; equal ones by their bytes."""
    order = [F.collate("doc_class", COLLATION), F.collate("field", COLLATION), "doc_class", "field"]
    names = [f"_o{i}" for i in range(4)]
    rows = struck.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, order, strict=True)})
    return numbered_rows(rows, [], names).withColumn(place, F.col("r")).drop("r", "n", "before", *names)


def struck_probes(probes: DataFrame, struck: DataFrame) -> DataFrame:
    """Probes without struck ones; a strike of no probe is an error."""
    key = ["doc_class", "field"]
    unknown = struck.join(probes, key, "left_anti").first()
    if unknown:
        raise ValueError(f"probes: strike of unknown probe {unknown.doc_class}/{unknown.field}")
    return probes.join(struck.select(*key), key, "left_anti")


def worksheet(goldens: DataFrame) -> list[str]:
    """Markdown lines of an audit sheet, a row for each probe and document."""
    head = ["| class | document | field | note | text | page | visible |", "|-|-|-|-|-|-|-|"]
    return head + [f"| {r.doc_class} | {r.doc} | {r.field.removeprefix('/')} |  |  |  |  |" for r in goldens.orderBy("doc_class", "doc", "field").toLocalIterator()]


def selection_json(drawn: dict[str, list[tuple[str, str]]], seed: int = SEED) -> str:
    return json.dumps({"formatVersion": 1, "seed": seed, "probes": {c: [{"field": f, "sourceClass": s} for f, s in v] for c, v in drawn.items()}}, indent=2)
