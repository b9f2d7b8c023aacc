import json

from pyspark.sql import functions as F

from sparkgauge.functions import text
from sparkgauge.operators import adapters
from sparkgauge.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chat(answer, logprob):
    return json.dumps({"choices": [{"message": {"content": answer}, "logprobs": {"content": [{"token": "x", "logprob": logprob}]}}]})


def test_chat_rows_of_one_key_or_none_keep_their_own_tokens(spark):
    rows = spark.createDataFrame([("a", chat('{"v": 1}', -1.0)), ("a", chat('{"v": 2}', -2.0)), (None, chat('{"v": 3}', -3.0)), ("b", "no")], "doc string, response string")
    fields, failed = adapters.chat_responses(rows, ["doc"])
    assert "Join" not in plan(fields)
    assert fields.columns == ["doc", "field", "value_json", "confidence"]
    got = sorted((r.value_json, r.doc, r.field, r.confidence) for r in fields.collect())
    assert [x[:3] for x in got] == [("1", "a", "/v"), ("2", "a", "/v"), ("3", None, "/v")]
    assert [round(x[3], 6) for x in got] == [0.367879, 0.135335, 0.049787]
    assert [r.doc for r in failed.collect()] == ["b"]


def test_answers_are_made_once(spark):
    """Six levels and one look at what is left; the ladder's four parses, and one for the kind of the answer."""
    rows = spark.createDataFrame([(1, "{}")], "k int, response string")
    fields, _ = adapters.candidate_responses(rows, ["k"])
    assert plan(fields).count("try_parse_json") <= 7


def test_rungs_of_a_repair_are_made_once(spark):
    odd = [(1, '```json\n{"a": 1, "a": 2}\n```'), (2, 'so: {"a": [1,],}.'), (3, "none"), (4, None), (5, '{"b": 1}')]
    rows = spark.createDataFrame(odd, "k int, raw string").repartition(1).select("k", text.repair_json(F.col("raw")).alias("out"))
    assert plan(rows).count("try_parse_json") <= 4
    assert {r.k: r.out for r in rows.collect()} == {1: '{"a":2}', 2: '{"a":[1]}', 3: None, 4: None, 5: '{"b":1}'}


ODD = ['{"a":1}', ' [1] ', "```json\n{\"a\": 1, \"a\": 2}\n```", 'so: {"a": [1,],}.', "x [1, 2,] y", "none", "", None, "tru", "true", "null x", '{"a":1} x', "\u00a0```\n[1]\n```\u00a0", "\u3000 3 \u3000", "-", "-1", '{"a"', 'a } { b', "\ufeff{}", '{"b":1,"b":{"c":1.50}', '"s', '"s"', "NaN", 'n: {"a":1,"a":[{"b":1,"b":2},],}']


def test_repair_as_columns_is_the_repair_of_one_column(spark):
    rows = spark.createDataFrame([*enumerate(ODD)], "k int, raw string").repartition(1)
    got = adapters.repaired(rows, F.col("raw"), "out").withColumn("one", text.repair_json(F.col("raw")))
    assert got.columns == ["k", "raw", "out", "one"]
    found = {r.k: (r.out, r.one) for r in got.collect()}
    assert all(a == b for a, b in found.values()) and len(found) == len(ODD)
    wanted = {0: '{"a":1}', 1: "[1]", 2: '{"a":2}', 3: '{"a":[1]}', 4: "[1,2]", 5: None, 6: None, 7: None, 8: None, 9: "true", 12: "[1]", 13: "3", 14: None, 15: "-1", 16: None, 17: None, 20: None, 21: '"s"', 22: None, 23: '{"a":[{"b":2}]}'}
    assert {k: found[k][0] for k in wanted} == wanted


def test_what_does_not_begin_like_json_does_not_parse(spark):
    begins = [chr(c) + rest for c in range(0x3100) for rest in ("", "1", "{}", "rue", "alse", "ull", "aN", "nfinity", ".5", '"')]
    rows = spark.createDataFrame([(b,) for b in [*begins, "\ufeff{}", "\ufeff1", "-.5", "-Infinity", "+1", " \t\r\n-0"]], "raw string")
    assert rows.filter(F.try_parse_json("raw").isNotNull() & text.repair_text(F.col("raw")).isNull()).count() == 0


def test_responses_are_read_once_and_repaired_in_compiled_code(spark, tmp_path):
    spark.createDataFrame([(i, 10 + i, "view") for i in range(8)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    for query in (queries.q_candidate_fields, queries.q_chat_fields):
        made = query(spark, str(tmp_path))
        assert plan(made).count("FileScan") == 1
        # Python gets strings, not lists: Spark would measure those anew from the batch's first row with every row
        handed = next(line for line in plan(made).splitlines() if "_last_of_keys(" in line)
        assert "lambdafunction" not in handed and "array(" not in handed
        rows = sorted(tuple(r) for r in made.filter("field is not null").collect())
        assert rows == sorted([(i, "/n", str(10 + i)) for i in range(1, 7)] + [(i, "/t/0", '"view"') for i in range(1, 7)])
        assert sorted(tuple(r) for r in made.filter("field is null").collect()) == [(0, None, None), (7, None, None)]


def test_one_table_of_responses_holds_what_two_hold(spark):
    answers = ['{"a": 1, "b": {}}', "{}", '{"": {"": null}}', "[1]", "no", '{"a": 1, "a": {"b": [2]}}', '{"k":[' * 5 + "1.50" + "]}" * 5, "null"]
    part = lambda a: json.dumps({"candidates": [{"content": {"parts": [{"text": a[:2]}, {"text": a[2:]}]}}]})
    wraps = {"candidates": part, "chat": lambda a: chat(a, -1.0), "annotation": lambda a: json.dumps({"document_annotation": a}), "job": lambda a: f'{{"data": {a}}}'}
    for kind, wrap in wraps.items():
        given = [(None if i == 0 else i // 2, wrap(a)) for i, a in enumerate(answers)] + [(None, None), (9, "{}"), (9, "{}")]
        rows = spark.createDataFrame(given, "doc int, response string")
        fields, failed = adapters.get_adapter(kind)(rows, ["doc"])
        one = adapters.responses(kind, rows, ["doc"])
        assert one.columns == fields.columns
        both = [tuple(r) for r in fields.collect()] + [(r.doc, None, None, None) for r in failed.collect()]
        assert sorted(map(repr, both)) == sorted(repr(tuple(r)) for r in one.collect())
        assert sum(r[1] is None for r in both) >= 5
