import math

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import text, values
from sparkgauge.functions.rng import Rng, quantile, with_uniform


def one(spark, expr, *args):
    return spark.createDataFrame([tuple(args)], [f"c{i}" for i in range(len(args))]).select(expr).first()[0]


@pytest.mark.parametrize(
    ("pointer", "wild"),
    [("/a/0/b/12/c", "/a/*/b/*/c"), ("/a/007/b", "/a/*/b"), ("/a/1a/b", "/a/1a/b"), ("/a~0b/0", "/a~0b/*"), ("/items/-", "/items/-"), ("/a//b", "/a//b"), ("/a/٣", "/a/٣"), ("0/1", "0/*")],
)
def test_wildcard(spark, pointer, wild):
    assert one(spark, text.wildcard(F.col("c0")), pointer) == wild


def test_canonical_field_has_no_first_part_rule(spark):
    assert one(spark, text.canonical_field(F.col("c0")), "0/1/x") == "*/*/x"


@pytest.mark.parametrize(
    ("raw", "money"),
    [("$1,880.00", "1880"), ("(12.50)", "-12.5"), ("-0", "0"), ("1.240,5", None), ("€ 0.10", "0.1"), ("007", "7"), ("1,23", None), ("abc", None), ("63.000", "63"), (".5", "0.5"), ("-$3", "-3")],
)
def test_currency(spark, raw, money):
    assert one(spark, text.currency_form(F.col("c0")), raw) == money


@pytest.mark.parametrize(
    ("raw", "iso"),
    [("2024-02-29", "2024-02-29"), ("02/30/2024", None), ("1/2/49", "2049-01-02"), ("1/2/50", "1950-01-02"), ("Sept. 3, 2021", "2021-09-03"), ("December 25, 1999", "1999-12-25"), ("tomorrow", None)],
)
def test_date(spark, raw, iso):
    assert one(spark, text.date_form(F.col("c0")), raw) == iso


def test_text_form_strips_what_javascript_strips(spark):
    assert one(spark, text.text_form(F.col("c0")), " ﻿ A　\n b \t") == "a b"


@pytest.mark.parametrize(
    ("raw", "fixed"),
    [('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('Sure: {"a":[1,2,],} ok', '{"a":[1,2]}'), ("x [1, 2] y", "[1,2]"), ("nothing", None)],
)
def test_repair(spark, raw, fixed):
    assert one(spark, text.repair_json(F.col("c0")), raw) == fixed


@pytest.mark.parametrize(
    ("value", "headline", "strict"),
    [("null", False, False), ('""', False, True), ('"  "', False, True), ('"N/A"', False, True), ('" Not  present "', False, True), ("0", True, True), ("false", True, True), ('"nil"', True, True), ('{"a":1}', True, True)],
)
def test_substantive(spark, value, headline, strict):
    for rule, expected in (("headline", headline), ("strict", strict)):
        assert one(spark, values.substantive(F.lit(True), F.col("c0"), F.lit(False), rule), value) is expected
    assert one(spark, values.substantive(F.lit(False), F.col("c0"), F.lit(False), "strict"), value) is False


def test_vocabulary_keeps_a_token_substantive(spark):
    assert one(spark, values.substantive(F.lit(True), F.col("c0"), F.lit(True)), '"none"') is True


def test_random_columns_equal_the_sequential_stream(spark):
    r = Rng(20260712)
    expected = [r.next() for _ in range(200)]
    got = [x.u for x in with_uniform(spark.range(200), 20260712, F.col("id"), "u").orderBy("id").collect()]
    assert got == expected


def test_variates_and_quantile():
    r = Rng(1)
    draws = [r.beta(5, 1.5) for _ in range(2000)]
    assert abs(sum(draws) / 2000 - 5 / 6.5) < 0.01
    assert quantile([1, 2, 4, 8], 0.25) == 1.75
    assert math.isnan(quantile([], 0.5))
    with pytest.raises(ValueError):
        r.gamma(0)


def test_white_space_is_that_of_javascript(spark):
    rows = spark.createDataFrame([("\x85a\x85",), ("\ufeffa\u2028",), ("\u180ea",)], "t string")
    assert [r[0] for r in rows.select(text.js_trim(F.col("t"))).collect()] == ["\x85a\x85", "a", "\u180ea"]


def test_a_line_end_is_no_part_of_an_index(spark):
    rows = spark.createDataFrame([("/a/12\n/b",), ("/a/12/b",)], "p string")
    assert [r[0] for r in rows.select(text.wildcard(F.col("p"))).collect()] == ["/a/12\n/b", "/a/*/b"]


def test_pointers_of_any_length_are_split(spark):
    p = "/x~1y" * 12_000
    assert spark.createDataFrame([(p,)], "p string").select(F.size(text.pointer_tokens(F.col("p")))).first()[0] == 12_000
