"""Line dedup by winnowing over line hashes.

The non-blank lines of a document, without the white space around them, have hashes.
A window is the shortest run of lines from a line on, or back from a line, that has at least
``window_chars`` characters, so a longer line is a window of its own; a text with fewer is one window.
Of each window the line with the smallest hash is the fingerprint, and its key is that hash with the
digest of the window's hashes: a common line has one key for each context it stands in, and
each key its own first position (documents by doc_id, then lines).  The lines of all other
positions of a key are deleted.

A run of ``window_chars`` characters is covered by the windows that lie in it, those from its lines on and those
back from them, so runs that stand earlier are found whole and nothing else is, and
a match needs no extension.  Hot windows meet their first position only, never each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, aside, materialise

WINDOW_CHARS = 32


def _strip(line: str) -> str:
    chars = SPACE_CHARS.replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    chars = "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in chars)
    return f"trim(BOTH '{chars}' FROM {line})"


def fingerprints(docs: DataFrame, window_chars: int = WINDOW_CHARS) -> DataFrame:
    """``doc_id, mark, line, key, near``: one row per distinct window.

    ``mark`` tells documents of one doc_id apart; ``line`` is the window's first one, counting non-blank lines from 0;
    ``key`` is the smallest of its hashes with the digest of them all; ``near`` has the numbers of its lines in the text.
    """
    w = int(window_chars)
    rows = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5("text")).alias("mark"),
        F.expr(
            f"filter(transform(split(text, '\\n', -1), (l, i) -> named_struct('no', i, 'line', {_strip('l')})), x -> x.line <> '')"
        ).alias("lines"),
    )
    rows = rows.select(
        "doc_id", "mark",
        F.expr("transform(lines, x -> unhex(md5(x.line)))").alias("keys"),
        F.expr("transform(lines, x -> char_length(x.line))").alias("sizes"),
        F.col("lines.no").alias("nos"),
    )
    # lines that fill a window, or null if there are not enough
    fill = lambda part: f"""
      aggregate({part}, named_struct('n', 0, 'k', 0),
        (x, s) -> named_struct('n', x.n + s, 'k', if(x.n < {w}, x.k + 1, x.k)), x -> if(x.n >= {w}, x.k, NULL))"""  # noqa: E731
    on = fill(f"slice(sizes, i + 1, {w})")
    back = fill(f"reverse(slice(sizes, greatest(1, i - {w} + 2), least(i + 1, {w})))")
    at = "slice(sequence(0, size(sizes)), 1, size(sizes))"
    rows = rows.withColumn(
        "spans",
        F.expr(f"""filter(array_distinct(flatten(transform({at}, i -> if(sizes[i] >= {w}, array(named_struct('line', i, 'n', 1)),
                   transform(array(named_struct('line', i, 'n', {on}), named_struct('line', i, 'n', -{back})),
                     x -> if(x.n < 0, named_struct('line', i + x.n + 1, 'n', -x.n), x)))))), x -> x.n IS NOT NULL)"""),
    ).withColumn(
        "spans", F.expr("if(size(spans) = 0 AND size(sizes) > 0, array(named_struct('line', 0, 'n', size(sizes))), spans)")
    ).withColumn(
        "spans",
        F.expr("""transform(spans, x -> named_struct('line', x.line, 'n', x.n, 'key', if(x.n = 1, keys[x.line],
                  concat(array_min(slice(keys, x.line + 1, x.n)), unhex(md5(array_join(transform(slice(keys, x.line + 1, x.n), k -> hex(k)), '')))))))"""),
    )
    # explode() would have the optimizer filter on size(spans) at the scan, all of the above computed twice
    rows = rows.select("doc_id", "mark", "nos", F.explode_outer("spans").alias("p"))
    return rows.filter(F.col("p").isNotNull()).select(
        "doc_id", "mark", "p.line", "p.key", F.expr("slice(nos, p.line + 1, p.n)").alias("near")
    )


def repeated_lines(docs: DataFrame, window_chars: int = WINDOW_CHARS) -> DataFrame:
    """``doc_id, mark, cut``: per document the numbers of the lines (from 0, sorted) that repeat earlier ones."""
    marks = materialise(fingerprints(docs, window_chars), "line-fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line")
    first = marks.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"))
    # written first, so that both sides of the join come straight from a shuffle, whose hot keys Spark can split
    first = materialise(first.filter("times > 1"), "first-lines")
    later = marks.join(first, "key").filter(place != F.col("first")).select("doc_id", "mark", F.col("near").alias("run"))
    return later.groupBy("doc_id", "mark").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("run")))).alias("cut")
    )


def dedup_lines(docs: DataFrame, window_chars: int = WINDOW_CHARS) -> DataFrame:
    """The rows of ``docs`` with their text after deletion, and ``deleted``: the numbers (from 0) of
    the lines that went, ``n_lines`` before.

    The first of equal runs stays, in order of doc_id (null last), then of the text's digest, then of lines.
    Blank lines stay and stand in no run.  A null text stays null, an empty one empty; a
    document all of whose lines repeat is left with an empty or blank text.  Rows that agree in doc_id and text are
    one document here and all get its result.  An empty table gives no rows.  Further columns pass
    through whatever their names, but for ``deleted`` and ``n_lines`` (in any case); ``n_chars``, if there,
    is that of the new text.
    """
    order, (docs, others) = docs.columns, aside(docs, ("doc_id", "text", "n_chars"))
    cuts = repeated_lines(docs, window_chars).select(
        F.col("doc_id").alias("_l_doc"), F.col("mark").alias("_l_mark"), F.col("cut").alias("_l_cut")
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_l_doc")) & (F.unhex(F.md5("text")) == F.col("_l_mark"))
    rows = docs.join(cuts, same, "left").withColumn("_l_all", F.split("text", "\n", -1))
    rows = rows.withColumn("deleted", F.coalesce("_l_cut", F.expr("cast(array() as array<int>)")))
    left = F.expr("transform(array_except(sequence(0, size(_l_all) - 1), deleted), i -> _l_all[i])")
    rows = rows.withColumn("_l_text", F.when(F.size("deleted") > 0, F.array_join(left, "\n")).otherwise(F.col("text")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("_l_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("deleted") > 0, F.char_length("_l_text").cast("long")).otherwise(F.col("n_chars"))
    every = {c: others[c] if c in others else new[c.lower()] for c in order if c.lower() not in ("deleted", "n_lines")}
    return rows.select(
        *[x.alias(c) for c, x in every.items()], "deleted",
        F.coalesce(F.size("_l_all"), F.lit(0)).cast("long").alias("n_lines"),
    )
