"""The corpus build: goldens of a split with the names of their files, a schema a class, and counts; all of it or nothing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpora
from ..operators.adapters import PAGE_CAP
from ..operators.order import settled
from ..sources import jsonl
from ..sources.jsonl import InputError
from ..sources.store import Store, publish

#: Names of the outputs.
COUNTS, GOLDEN, SCHEMA = "corpus-counts.json", "golden.{}.jsonl", "{}.schema.json"
#: From documents (``doc_class, doc, path``) to ``doc_class, doc, pages``.
PageCounter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Places:
    """``source/<class>/golden.jsonl``, ``split/<class>/golden.jsonl`` beside the PDF files, ``manifests/<class>.manifest.json``."""

    source: str
    split: str
    manifests: str


def class_names(spark: SparkSession, split: str, chosen: list[str] | None = None) -> list[str]:
    """The classes asked for, or every folder of the split; each once, by name."""
    store = Store(spark, split)
    found = chosen if chosen else [n for n in store.names() if store.fs.getFileStatus(store._path(n)).isDirectory()]
    names = sorted({c.strip() for c in found if c.strip()})
    if not names:
        raise InputError("no classes")
    for c in names:
        if c in (".", "..") or "/" in c or "\\" in c:
            raise InputError(f"{c} is no name of a class")
    return names


def _folder(path: str, at: int):
    return F.element_at(F.split(F.col(path), "/"), at)


def _documents(spark: SparkSession, places: Places, names: list[str]) -> DataFrame:
    """``doc_class, doc, path`` of the split's files; their bytes are only read if someone asks for them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load([f"{places.split}/{c}" for c in names])
    return files.select(_folder("path", -2).alias("doc_class"), _folder("path", -1).alias("doc"), "path", "content")


def _goldens(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    store = Store(spark, folder)
    if missing := [c for c in names if not store.exists(f"{c}/golden.jsonl")]:
        raise InputError(f"{folder}/{missing[0]}/golden.jsonl is missing")
    rows = jsonl.golden_rows(spark, [f"{folder}/{c}/golden.jsonl" for c in names])
    return rows.select(_folder("file", -2).alias("doc_class"), "doc", F.col("doc_class").alias("row_class"), "fields", F.to_json("fields").alias("cells"))


def _manifests(spark: SparkSession, places: Places, names: list[str]) -> DataFrame:
    store, rows = Store(spark, places.manifests), []
    for c in names:  # a small file a class
        name = f"{c}.manifest.json"
        if not store.exists(name):
            raise InputError(f"{places.manifests}/{name} is missing")
        try:
            said = json.loads(store.read(name))
        except ValueError:
            said = None
        text = lambda k, said=said: said.get(k) if isinstance(said, dict) and isinstance(said.get(k), str) else None
        rows.append((c, text("class"), text("calTestGoldenHash")))
    return spark.createDataFrame(rows, "doc_class string, named string, expected string")


def _counts(sums: list, listed: Iterator, cap: int) -> Iterator[str]:
    """The text of the counts, with a line a document as its format asks for; documents come one by one."""
    put = lambda x: json.dumps(x)
    group = lambda r, s: {"documents": r[f"docs{s}"], "fields": r[f"fields{s}"] or 0, "goldenAbsentFields": r[f"absent{s}"] or 0, "pages": r[f"pages{s}"] or 0}
    by = {r["doc_class"]: r for r in sums}
    yield f'{{\n  "formatVersion": 1,\n  "conditionalPageLimit": {cap},\n  "classes": {{'
    over, last, histogram, own = [], None, {}, []

    def tail() -> str:
        bins = {str(k): histogram[k] for k in sorted(histogram)}
        return f'],\n      "pageHistogram": {put(bins)},\n      "conditionalExclusions": {put(own)}\n    }}'

    for r in listed:
        if r.doc_class != last:
            if last is not None:
                yield tail() + ","
                histogram, own = {}, []
            c = by[r.doc_class]
            yield f'\n    {put(r.doc_class)}: {{\n      "full": {put(group(c, ""))},\n      "atOrBelowPageLimit": {put(group(c, "_within_cap"))},\n      "pageCounts": ['
        yield ("," if r.doc_class == last else "") + "\n        " + put({"doc": r.doc, "pages": r.pages})
        last = r.doc_class
        histogram[r.pages] = histogram.get(r.pages, 0) + 1
        if r.pages > cap:
            own.append({"docClass": r.doc_class, "doc": r.doc, "pages": r.pages, "fields": r.fields, "goldenAbsentFields": r.absent})
            over.append(own[-1])
    branches = {"capRemoved": group(by[None], ""), "capConfirmed": group(by[None], "_within_cap")}
    yield (tail() if last is not None else "") + f'\n  }},\n  "branches": {put(branches)},\n  "conditionalExclusions": {put(over)}\n}}\n'


def build(spark: SparkSession, places: Places, out: str, count_pages: PageCounter, chosen: list[str] | None = None, cap: int = PAGE_CAP) -> dict:
    """Check everything, then publish ``golden.<class>.jsonl`` (a table of parts in the order of documents), ``<class>.schema.json`` and
    ``corpus-counts.json`` as one version under ``out``; returns what ``current.json`` says.

    All faults are found before the first output is written; the first by class, document and kind is raised, with their number.  Documents with more than
    ``cap`` pages count in ``capRemoved`` and not in ``capConfirmed``, and are listed.
    """
    names = class_names(spark, places.split, chosen)
    classes = spark.createDataFrame([(c,) for c in names], "doc_class string")
    found = _documents(spark, places, names)
    pages = count_pages(found)
    documents = settled(found.select("doc_class", "doc").join(pages.select("doc_class", "doc", "pages").distinct(), ["doc_class", "doc"], "left"))
    source, frozen = _goldens(spark, places.source, names), _goldens(spark, places.split, names)
    hashes = spark.read.format("binaryFile").load([f"{places.split}/{c}/golden.jsonl" for c in names]).select(_folder("path", -2).alias("doc_class"), F.sha2("content", 256).alias("sha256"))
    built = settled(corpora.build_rows(documents, source.drop("fields"), frozen.drop("fields")))
    fields = source.select("doc_class", corpora.file_name(F.col("doc")).alias("doc"), "fields").join(documents, ["doc_class", "doc"], "left_semi").select("doc_class", "doc", F.posexplode("fields").alias("field_ord", "field", "cell"))
    faults = corpora.class_faults(classes, documents, _manifests(spark, places, names), hashes).unionByName(corpora.document_faults(built)).unionByName(corpora.field_faults(fields))
    faults = settled(faults)
    if (first := faults.orderBy("doc_class", F.asc_nulls_first("doc"), "fault").first()) is not None:
        where = first.doc_class if first.doc is None else f"{first.doc_class}/{first.doc}"
        raise InputError(f"{where}: {first.fault} ({faults.count()} faults in all)")

    goldens = source.select("doc_class", corpora.file_name(F.col("doc")).alias("doc"), "fields").join(documents, ["doc_class", "doc"])
    line = F.to_json(F.struct("doc", F.col("doc_class").alias("docClass"), F.concat("doc_class", F.lit(".schema.json")).alias("schema"), "fields"))
    states = goldens.select("doc_class", "doc", F.explode("fields").alias("field", "cell")).select("doc_class", "doc", "field", "cell.state")
    per = goldens.select("doc_class", "doc", "pages", F.size("fields").alias("fields"), F.size(F.filter(F.map_values("fields"), lambda c: c["state"] == "missing")).alias("absent"))
    sums = corpora.document_sums(per, cap).collect()  # a row a class
    schemas = {c: corpora.nullable_schema(states.filter(F.col("doc_class") == c).select(F.col("field").alias("pointer"))) for c in names}

    def make(attempt: Store) -> None:
        rows = goldens.select("doc_class", "doc", line.alias("value")).repartitionByRange("doc_class", "doc").sortWithinPartitions("doc_class", "doc")
        rows.select(F.col("doc_class").alias("class"), "value").write.partitionBy("class").text(attempt.at("goldens"))
        for name in attempt.names("goldens"):
            if name.startswith("class="):
                c = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.removeprefix("class="))
                attempt.rename(f"goldens/{name}", GOLDEN.format(c))
        attempt.delete("goldens")
        for c, schema in schemas.items():
            attempt.write(SCHEMA.format(c), [corpora.format_schema(schema) + "\n"])
        attempt.write(COUNTS, _counts(sums, per.orderBy("doc_class", "doc").toLocalIterator(), cap))

    return publish(spark, out, make, {"classes": names})


def summary(counts: dict) -> list[str]:
    """The counts as lines for people."""
    say = lambda c: f"{c['documents']} docs, {c['pages']} pages, {c['fields']} fields, {c['goldenAbsentFields']} absent"
    limit, lines = counts["conditionalPageLimit"], []
    for c, own in sorted(counts["classes"].items()):
        lines += [f"{c}: full {say(own['full'])}", f"{c}: <={limit}pp {say(own['atOrBelowPageLimit'])}"]
    lines += [f"cap-removed primary: {say(counts['branches']['capRemoved'])}", f"cap-confirmed primary: {say(counts['branches']['capConfirmed'])}", f"conditional exclusions (>{limit}pp):"]
    over = [f"  {x['docClass']}/{x['doc']}: {x['pages']} pages, {x['fields']} fields, {x['goldenAbsentFields']} absent" for x in counts["conditionalExclusions"]]
    return lines + (over or ["  none"])
