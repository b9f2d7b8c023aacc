"""Sinks: single JSON files, per-repeat prediction files, the packaged dataset and its sweep."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoint import durable_write

#: What must not leave with a dataset, as name and pattern.
SWEEPS = {
    "local path": r"[A-Za-z]:\\|/Users/|/home/",
    "machine identity": r"(?i)hostname|DESKTOP-|LAPTOP-",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "key-shaped string": r"AIza[0-9A-Za-z_-]{10,}|sk-[A-Za-z0-9]{20,}|Bearer\s+[A-Za-z0-9._-]{15,}",
    "cloud project id": r"projects/(?!<gcp-project>)[A-Za-z0-9-]+/",
    "edge request ray": r"cf-ray [a-f0-9]{8,}-[A-Za-z]{3}\b",
}


def write_json(path: str | Path, value: object) -> None:
    durable_write(path, json.dumps(value, indent=2, sort_keys=False) + "\n")


def sweeps(own_domain: str | None = None, extra: dict[str, str] | None = None) -> dict[str, str]:
    """The standing patterns and the user's own; addresses of ``own_domain`` may leave."""
    found = SWEEPS | (extra or {})
    if own_domain:
        found["email"] = found["email"].replace("@", "@(?!" + re.escape(own_domain) + ")", 1)
    return found


def sweep_hits(rows: DataFrame, text: Column, extra: dict[str, str] | None = None, own_domain: str | None = None) -> DataFrame:
    """``label, hit``: one row for each text and pattern that matches; the first 60 characters of it."""
    patterns = sweeps(own_domain, extra)
    found = F.array(*[F.struct(F.lit(k).alias("label"), F.substring(F.regexp_substr(text, F.lit(p)), 1, 60).alias("hit")) for k, p in patterns.items()])
    # explode() would have the optimizer filter on the array's size, each pattern looked for twice
    return rows.select(F.explode_outer(F.filter(found, lambda x: x["hit"].isNotNull())).alias("f")).filter("f is not null").select("f.*")


def denylist(text: str) -> dict[str, str]:
    """A user's own patterns, a line each, without regard to case; blank lines and those that begin with # say nothing."""
    said = enumerate((line.strip() for line in text.split("\n")), 1)
    return {f"own pattern of line {at}": f"(?i){line}" for at, line in said if line[:1] not in ("", "#")}


def write_dataset(tables: dict[str, DataFrame], folder: str, order: dict[str, list[str]], extra: dict[str, str] | None = None) -> None:
    """Ordered JSON Lines, refused as a whole if the sweep finds anything in a row."""
    for name, table in tables.items():
        hit = sweep_hits(table.select(F.to_json(F.struct(*table.columns)).alias("line")), F.col("line"), extra).first()
        if hit:
            raise ValueError(f"{name}: {hit.label}: {hit.hit}")
    for name, table in tables.items():
        # sorted over the cluster; parts in order of their names are the table in order
        table.orderBy(*order[name]).select(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def content_digest(folder: str | Path) -> str:
    """SHA-256 of the bytes of a table's parts, in the order of their names; a single file is its own only part."""
    path, digest = Path(folder), hashlib.sha256()
    for part in sorted(path.glob("part-*")) if path.is_dir() else [path]:
        with part.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def write_repeats(records: DataFrame, folder: str) -> None:
    """Predictions by repeat, one folder a repeat, ordered by document."""
    lines = records.select("repeat", "doc_ord", F.to_json(F.struct(*[c for c in records.columns if c != "doc_ord"])).alias("value"))
    lines.repartitionByRange("repeat").sortWithinPartitions("repeat", "doc_ord").select("repeat", "value").write.mode("overwrite").partitionBy("repeat").text(folder)
