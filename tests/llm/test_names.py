"""Columns whose names are an operator's own, or hard to say."""

import pytest
from pyspark.sql import functions as F

from sparkgauge.llm.line_dedup import dedup_lines
from sparkgauge.llm.secrets import find_secrets
from sparkgauge.llm.toxicity import Limits, keep_clean

HARD = ["_l_cut", "_l_all", "_l_text", "a.b", "a`c", "Deleted", "N_LINES", "_st", "_sc", "_sw", "Base", "FOUND", "_aside", "c0", "score", "_own_score", "Score ", "line"]


@pytest.fixture(scope="module")
def hard(spark):
    line = "a line that is long enough to be a window of its own"
    df = spark.createDataFrame([(1, f"{line}\nx", "s"), (2, f"{line}\npassword: abcdefghijklmnop", "s"), (3, None, None)], "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in HARD])


def values(rows, columns):
    return sorted(([r[c] for c in columns] for r in rows), key=repr)


def test_line_dedup(hard):
    got = dedup_lines(hard)
    kept = [c for c in hard.columns if c.lower() not in ("deleted", "n_lines")]
    assert got.columns == [*kept, "deleted", "n_lines"]
    others = [c for c in kept if c != "text"]
    assert values(got.collect(), others) == values(hard.collect(), others)
    assert {r.doc_id: (r.text, r.deleted, r.n_lines) for r in got.collect()}[2] == ("password: abcdefghijklmnop", [0], 2)


def test_secrets(hard):
    got = find_secrets(hard)
    kept = [c for c in hard.columns if c.lower() not in ("base", "found")]
    assert got.columns == [*kept, "base", "found"]
    assert values(got.collect(), kept) == values(hard.collect(), kept)
    assert {r.doc_id: len(r.base) for r in got.collect()} == {1: 0, 2: 1, 3: 0}


def test_toxicity(spark, hard):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    got = keep_clean(hard, labels, Limits(epochs=1))
    assert got.columns == hard.columns
    assert values(got.collect(), hard.columns) == values(hard.collect(), hard.columns)
