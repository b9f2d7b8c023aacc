"""Digests of ordered tables of lines, by ranges: two tables are told apart, and where, from a row a range.

A line's hash takes in its place, and the hashes of a range are combined by exclusive or: parts of a range may be combined
anywhere and in any order, so no task reads a range alone and it doesn't matter how a table is cut into files.  A range's digest
and the whole table's are made alike, the one from the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered_rows

#: Lines of a range.
RANGE = 65_536
_WORDS = [f"w{i}" for i in range(4)]


@dataclass(frozen=True)
class Difference:
    """The first range (lines from 0, the last excluded) in which two tables differ, with how many lines each has there."""

    first: int
    end: int
    lines: tuple[int, int]


def _combined(columns: list[str]) -> list[Column]:
    return [F.bit_xor(c).alias(c) for c in columns]


def _hex() -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in _WORDS]).alias("digest")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, ord, value``: the lines of a file, or of a folder's parts, with what orders them."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("ord"), "value")


def range_digests(rows: DataFrame, order: list[str], value: str = "value", size: int = RANGE) -> DataFrame:
    """``range, lines, digest`` of rows in the order of ``order``, ``size`` lines a range."""
    return _ranges(rows, order, value, size).select("range", "lines", _hex())


def _ranges(rows: DataFrame, order: list[str], value: str, size: int) -> DataFrame:
    placed = numbered_rows(rows.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(value, F.lit("")).alias("_line")), [], [f"_o{i}" for i in range(len(order))])
    h = F.sha2(F.concat_ws("\n", F.col("r").cast("string"), F.col("_line")), 256)
    words = [F.conv(F.substring(h, 16 * i + 1, 16), 16, -10).cast("long").alias(w) for i, w in enumerate(_WORDS)]
    return placed.select(F.floor(F.col("r") / size).alias("range"), *words).groupBy("range").agg(F.count(F.lit(1)).alias("lines"), *_combined(_WORDS))


def digest(rows: DataFrame, order: list[str], value: str = "value") -> str:
    """Of the whole table: its number of lines, and its ranges' digests combined."""
    whole = _ranges(rows, order, value, RANGE).agg(F.sum("lines").alias("lines"), *_combined(_WORDS)).select("lines", _hex()).first()
    return f"{whole.lines or 0}:{whole.digest or ''}"


def path_digest(spark: SparkSession, path: str) -> str:
    return digest(lines_of(spark, path), ["file", "start", "ord"])


def difference(spark: SparkSession, a: str, b: str, size: int = RANGE) -> Difference | None:
    """Where two tables of lines, on any store, first differ; null if they are the same."""
    one, two = (range_digests(lines_of(spark, p), ["file", "start", "ord"], size=size) for p in (a, b))
    both = one.alias("a").join(two.alias("b"), "range", "full").select("range", F.col("a.digest").alias("da"), F.col("b.digest").alias("db"), F.col("a.lines").alias("na"), F.col("b.lines").alias("nb"))
    r = both.filter(~F.col("da").eqNullSafe(F.col("db"))).orderBy("range").first()
    return None if r is None else Difference(r.range * size, r.range * size + max(r.na or 0, r.nb or 0), (r.na or 0, r.nb or 0))
