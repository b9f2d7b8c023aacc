import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkgauge import cli
from sparkgauge.operators import adapters, corpora, dataset, probes, runlog
from sparkgauge.plans import matrix, queries, report, score
from sparkgauge.sources import checkpoint, jsonl, sinks

GOOD = {"doc": "a.pdf", "docClass": "inv", "fields": {"/total": {"state": "present", "value": 1240.5}, "/tax": {"state": "null"}, "/po": {"state": "missing"}}}


def write(path: Path, *rows) -> str:
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_golden_scan(spark, tmp_path):
    rows = jsonl.read_goldens(spark, write(tmp_path / "g.jsonl", GOOD, "", GOOD | {"doc": "b.pdf"})).orderBy("doc_ord", "field_ord").collect()
    assert [(r.doc, r.field, r.state, r.value_json) for r in rows][:3] == [("a.pdf", "/total", "present", "1240.5"), ("a.pdf", "/tax", "null", None), ("a.pdf", "/po", "missing", None)]


@pytest.mark.parametrize(
    ("bad", "why"),
    [("{", "invalid JSON"), ("[1]", "not an object"), (GOOD | {"doc": ""}, "missing doc"), ({k: v for k, v in GOOD.items() if k != "docClass"}, "docClass"), (GOOD | {"schema": 3}, "schema"), (GOOD | {"fields": [1]}, "fields"),
     (GOOD | {"fields": {"/a": {"state": "odd"}}}, "unknown state"), (GOOD | {"fields": {"/a": {"state": "present"}}}, "disagree"), (GOOD | {"fields": {"/a": {"state": "null", "value": 1}}}, "disagree")],
)
def test_golden_faults_name_the_line(spark, tmp_path, bad, why):
    path = write(tmp_path / "g.jsonl", GOOD, "", bad)
    with pytest.raises(jsonl.InputError, match=f":3: .*{why}"):
        jsonl.read_goldens(spark, path)


def test_empty_and_repeated_goldens(spark, tmp_path):
    with pytest.raises(jsonl.InputError, match="no rows"):
        jsonl.read_goldens(spark, write(tmp_path / "e.jsonl", ""))
    with pytest.raises(jsonl.InputError, match="2 times"):
        jsonl.read_goldens(spark, write(tmp_path / "g.jsonl", GOOD, GOOD))


def test_records_defaults_and_kinds(spark, tmp_path):
    path = write(tmp_path / "p.jsonl", {"kind": "header"}, {"doc": "a", "docClass": "c", "fields": {"/x": {"value": None}, "/y": {"value": {"b": 1, "a": 2}, "confidence": 0.5}}})
    (r,) = jsonl.read_records(spark, path).collect()
    assert (r.repeat, r.availability, r.request_attempts, r.transport_retries) == (1, "completed", 1, 0)
    assert r.fields["/x"].value_json == "null"
    assert r.fields["/y"].value_json == '{"a":2,"b":1}'


def test_rules_strikes_worksheet(spark, tmp_path):
    path = write(tmp_path / "n.json", {"docClass": "c", "normalizers": {"/a/*/b": "date"}})
    assert [tuple(r) for r in jsonl.read_rules(spark, path).collect()] == [("c", "/a/*/b", "date")]
    for bad in ({"/a/0/b": "date"}, {"a": "text"}, {"/a": "number"}):
        with pytest.raises(jsonl.InputError):
            jsonl.read_rules(spark, write(tmp_path / "x.json", {"docClass": "c", "normalizers": bad}))
    path = write(tmp_path / "s.json", {"auditedCells": 3, "struck": [{"docClass": "c", "doc": "d", "field": "/f", "reason": "visible", "page": 1}]})
    assert jsonl.read_strikes(spark, path).first().reason == "visible"
    path = write(tmp_path / "w.md", "# Sheet", "| class | document | field | note | text | page | visible |", "|-|-|-|-|-|-|-|", "| c | d1 | f |  |  | 1 | y |", "| c | d2 | f |  |  |  | n |", "| c | d0 | f | | | | Y |")
    sheet = jsonl.read_worksheet(spark, path)
    assert [tuple(r) for r in probes.strikes(sheet).collect()] == [("c", "f", ["d1", "d0"])]


def test_checkpoint(spark, tmp_path):
    path = tmp_path / "run.jsonl"
    checkpoint.start(path, "f1", "now", "clean")
    for r in (1, 1, 2):
        checkpoint.durable_append(path, {"kind": "prediction", "docClass": "c", "doc": "d", "repeat": r})
    with path.open("a") as f:
        f.write('{"kind": "pred')
    log = checkpoint.load(path, "f1")
    assert (len(log.records), log.torn) == (2, True)
    assert checkpoint.load(path, "other") is None
    assert checkpoint.damage(spark, str(path)) == (5, 4)
    checkpoint.start(path, "f2", "now", "clean")
    assert (tmp_path / "run.jsonl.stale-1").exists()
    path.write_text('{"kind": "header"}\n{bad\n{"kind": "prediction"}\n')
    with pytest.raises(jsonl.InputError, match=":2: damaged"):
        checkpoint.load(path, "f1")
    with checkpoint.Lease(tmp_path), pytest.raises(RuntimeError, match="held"):
        checkpoint.Lease(tmp_path).acquire()
    (tmp_path / ".lease").write_text("999999999")
    with checkpoint.Lease(tmp_path):
        pass


def leaves_of(value):
    """Pointers and values of a tree's leaves, by a walk in Python."""
    out, left = [], [("", value)]
    while left:
        at, v = left.pop()
        if isinstance(v, dict | list):
            pairs = list(v.items()) if isinstance(v, dict) else [(str(i), x) for i, x in enumerate(v)]
            left += [(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", x) for k, x in reversed(pairs)]
        elif at:
            out.append((at, v))
    return out


def test_many_documents_and_levels(spark):
    """More nodes than a recursive query has rows, and more levels than it has."""
    many = spark.range(700_000).select("id", F.lit('{"a":[1,2],"b":{}}').alias("j"))
    assert adapters.flatten(many, ["id"], "j").groupBy("field").count().orderBy("field").collect() == [("/a/0", 700_000), ("/a/1", 700_000)]
    deep = spark.createDataFrame([(1, '{"a":' * 150 + "1" + "}" * 150)], "id int, j string")
    assert adapters.flatten(deep, ["id"], "j").first().field == "/a" * 150


def test_flatten(spark):
    value = {"a": {"b/c": [1, None, {"~": "x"}], "none": [], "e": {}}, "t": True}
    rows = spark.createDataFrame([("d", json.dumps(value)), ("e", "3"), ("f", "{")], "doc string, j string")
    got = sorted((r.field, r.value_json) for r in adapters.flatten(rows, ["doc"], "j").collect())
    assert got == [("/a/b~1c/0", "1"), ("/a/b~1c/1", "null"), ("/a/b~1c/2/~0", '"x"'), ("/t", "true")]
    assert sorted(k for k, _ in leaves_of(value)) == [f for f, _ in got]


def test_flatten_has_no_limit_of_levels(spark):
    deep = lambda n: '{"a":[' * n + "1.50" + "]}" * n
    rows = spark.createDataFrame([(n, deep(n)) for n in (60, 5000)], "doc long, j string")
    assert {(r.doc, r.field, r.value_json) for r in adapters.flatten(rows, ["doc"], "j").collect()} == {(n, "/a/0" * n, "1.5") for n in (60, 5000)}
    assert leaves_of(json.loads(deep(60))) == [("/a/0" * 60, 1.5)]


def test_flatten_text_reads_what_the_parser_reads(spark):
    texts = ['{"a":1} x', '{"a":1,"a":2}', '{"a":NaN}', '{"a":01}', "[1.0,1e5,1.50,-0,123456789012345678901234567890]", '{"a":"\t"}', "{'a':1}", '{"a":1,}', '{"a" 1}', "[1,]", "[,1]",
             "[1 2]", "[1}", "{", "", "[]", "{}", "[[],{}]", ' \n{"a":"\\u00e9\\n","\\u0062/~":[true,false,null,{"":"x"}]}', "[tru]", "[nulls]", "[1.]", "[.5]", "[-]", '["\\x"]', '{"a":1}}', "3", "null"]
    rows = spark.createDataFrame([*enumerate(texts)], "doc long, j string")
    parsed = {r.doc: json.loads(r.v) for r in rows.selectExpr("doc", "to_json(try_parse_json(j)) v").collect() if r.v is not None}
    wanted = {(d, f, json.dumps(v, ensure_ascii=False)) for d, x in parsed.items() for f, v in leaves_of(x)}
    # VARIANT refuses an object that repeats a key; here the last value counts
    wanted |= {(1, "/a", "2")}
    assert {(r.doc, r.field, r.value_json) for r in adapters.flatten(rows, ["doc"], "j").collect()} == wanted


@pytest.mark.parametrize("text", ['{"a":{"x":1,"y":2},"b":3,"a":[4]}', '{"a":1,"a":{"c":[1,2]},"a":{"c":{}}}', '{"o":[{"k":1,"k":2},{"k":{"k":3,"k":4}}],"p":{"q":1},"o":null}', '{"a":[],"a":7,"b":{"a":1,"a":2},"b":{"z":0}}'])
def test_the_last_of_repeated_keys_counts(spark, text):
    assert sorted(adapters.flatten_text(text)) == sorted((f, json.dumps(v)) for f, v in leaves_of(json.loads(text)))
    response = json.dumps({"choices": [{"message": {"content": f"```json\n{text}\n```"}}], "model": "m"})
    rows = spark.createDataFrame([("d", response)], "doc string, response string")
    fields, failed = adapters.chat_responses(rows, ["doc"])
    assert sorted((r.field, r.value_json) for r in fields.collect()) == sorted((f, json.dumps(v)) for f, v in leaves_of(json.loads(text)))
    assert failed.count() == 0


def test_probe_pool_takes_all_events(spark, tmp_path):
    rows = [(7, 1, "a"), (1001, 1, "b"), (14, 2, "b"), (70_000, 1, "b"), (12, 3, "c")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.doc_class, r.field, r.source_class, r["at"]) for r in queries.q_probe_pool(spark, str(tmp_path)).collect()}
    # a has f1_0; b has f1_0 (twice) and f2_0; c has f3_5
    assert got == {
        ("a", "f2_0", "b", 0), ("a", "f3_5", "c", 1), ("b", "f3_5", "c", 0), ("c", "f1_0", "a", 0), ("c", "f2_0", "b", 1),
    }


def test_mappers(spark):
    chat = {"choices": [{"message": {"content": '```json\n{"total": "12", "x": null}\n```'}, "logprobs": {"content": [{"token": "12", "logprob": 0.0}, {"token": "{", "logprob": -9.0}]}}]}
    rows = spark.createDataFrame([("d", json.dumps(chat)), ("bad", "{}")], "doc string, response string")
    fields, failed = adapters.get_adapter("chat")(rows, ["doc"])
    assert {r.field: (r.value_json, r.confidence) for r in fields.collect()}["/total"] == ('"12"', 1.0)
    assert [r.doc for r in failed.collect()] == ["bad"]
    parts = {"candidates": [{"content": {"parts": [{"text": '{"a": '}, {"text": '"1"}'}]}}]}
    rows = spark.createDataFrame([("d", json.dumps(parts))], "doc string, response string")
    assert adapters.candidate_responses(rows, ["doc"])[0].first().value_json == '"1"'
    for note in ('{"a": 1}', {"a": 1}):
        rows = spark.createDataFrame([("d", json.dumps({"document_annotation": note}))], "doc string, response string")
        assert adapters.annotation_responses(rows, ["doc"])[0].first().field == "/a"
    stated = {"fields": {"/a": {"state": "present", "value": "v", "confidence": 0.7}, "/b": {"state": "missing"}, "/c": {"state": "null"}}}
    broken = {"fields": {"/a": {"state": "present"}}}
    rows = spark.createDataFrame([("d", json.dumps(stated)), ("e", json.dumps(broken))], "doc string, response string")
    fields, failed = adapters.stated_responses(rows, ["doc"])
    assert {r.field: r.value_json for r in fields.collect()} == {"/a": '"v"', "/c": "null"}
    assert [r.doc for r in failed.collect()] == ["e"]
    with pytest.raises(ValueError, match="unknown adapter"):
        adapters.get_adapter("x")


def test_extraction_retries(spark):
    def call(row):
        if row["doc"] == "down":
            raise ConnectionError("503")
        if row["doc"] == "odd":
            raise ValueError("no JSON")
        return {"ok": 1}

    units = spark.createDataFrame([("up",), ("down",), ("odd",)], "doc string")
    got = {r.doc: (r.availability, r.request_attempts) for r in adapters.run_extraction(units, call).collect()}
    assert got == {"up": ("completed", 1), "down": ("transport_failure", 3), "odd": ("contract_failure", 1)}


def test_probes(spark):
    leaf = {"type": ["string", "null"]}
    schemas = {"alpha": {"properties": {"a1": leaf, "shared": leaf, "list": {"type": "array"}}}, "beta": {"properties": {"b1": leaf, "b2": leaf, "shared": leaf}}, "gamma": {"properties": {"g1": leaf, "g2": leaf, "b2": leaf}}}
    pool = probes.pools(probes.leaf_fields(spark, schemas))
    assert [(r.field, r.source_class) for r in pool.filter("doc_class = 'alpha'").orderBy("at").collect()] == [("b1", "beta"), ("b2", "beta"), ("g1", "gamma"), ("g2", "gamma")]
    drawn = probes.draw(pool, 7, 2)
    assert drawn == probes.draw(pool, 7, 2)
    assert all(len(set(v)) == 2 for v in drawn.values())
    with pytest.raises(ValueError, match="pool"):
        probes.draw(pool, 7, 9)
    assert probes.probe_schema(schemas["alpha"], [("z", "beta")])["required"] == ["z"]
    p = spark.createDataFrame([("c", "f")], "doc_class string, field string")
    with pytest.raises(ValueError, match="unknown probe"):
        probes.struck_probes(p, spark.createDataFrame([("c", "g")], "doc_class string, field string"))


def test_schema_from_pointers(spark):
    of = lambda *p: spark.createDataFrame([(x,) for x in p], "pointer string")
    s = corpora.nullable_schema(of("/b", "/items/0/y", "/items/1/x", "/a~1c"))
    assert list(s["properties"]) == ["a/c", "b", "items"]
    assert s["properties"]["items"]["items"]["required"] == ["x", "y"]
    for bad in (("/a", "/a/b"), ("/a/0", "/a/x")):
        with pytest.raises(jsonl.InputError):
            corpora.nullable_schema(of(*bad))
    assert json.loads(corpora.format_schema(s)) == s


def test_dataset_and_sweep(spark, tmp_path):
    rows = spark.createDataFrame([("a1", "main", "c", True), ("a1", "main", "c", None)], "arm string, pass string, doc_class string, fabricated boolean")
    assert tuple(dataset.summary(rows).first())[3:] == (2, 1, 1)
    bad = spark.createDataFrame([("see /home/x and me@example.org",), ("fine",)], "v string")
    assert sorted(r.label for r in sinks.sweep_hits(bad, F.col("v")).collect()) == ["email", "local path"]
    with pytest.raises(ValueError, match="local path|email"):
        sinks.write_dataset({"t": bad}, str(tmp_path / "out"), {"t": ["v"]})
    assert not (tmp_path / "out").exists()
    assert sinks.denylist("# no\nfoo\n\nbar") == {"own pattern of line 2": "(?i)foo", "own pattern of line 4": "(?i)bar"}
    assert sinks.same_rows(bad, bad)


def test_streaks(spark):
    what = ["completed", "contract_failure", "contract_failure", "transport_failure", "contract_failure"]
    r = spark.createDataFrame([("a", i, w) for i, w in enumerate(what)], "arm string, seq int, availability string")
    assert [x.streak for x in runlog.streaks(r, ["arm"], ["seq"]).orderBy("seq").collect()] == [0, 1, 2, 0, 1]
    assert runlog.trips(r, ["arm"], ["seq"], 2).first().seq == 2
    assert runlog.trailing_streak(r, ["arm"], ["seq"]).first().trailing == 1
    h = runlog.health(r.withColumn("repeat", F.lit(1)), 9, 1, ["seq"])
    assert (h["status"], h["aggregate"]["attempted"]) == ("paused", 5)


def test_matrix(spark):
    m = matrix.Matrix((matrix.Arm("a1", "stated", 0.5), matrix.Arm("a4", "annotation", 0.1)), ("c",), 3, cap_branch="cap-confirmed", excluded=(("c", "d2"),))
    docs = spark.createDataFrame([("c", "main", "d1"), ("c", "main", "d2"), ("c", "probe", "d1")], "doc_class string, pass string, doc string")
    rows = {(r.arm, r["pass"]): r for r in matrix.cells(spark, m, docs).collect()}
    assert rows["a4", "main"].run_docs == 1
    assert rows["a4", "main"].golden == "golden.c.capped.jsonl"
    assert rows["a1", "main"].scorings == ["primary", "appendix"]
    assert rows["a1", "main"].expected_usd == 3.0
    assert rows["a1", "probe"].repeats == 1
    for bad in (matrix.Matrix((), ("c",)), matrix.Matrix((matrix.Arm("a", "x"),), ("../c",)), matrix.Matrix((matrix.Arm("a", "x", extra=("--out",)),), ("c",))):
        with pytest.raises(ValueError):
            bad.validate()


def test_commands_end_to_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    fields = {f"/f{i}": {"state": "present", "value": f"v{i}"} for i in range(3)} | {"/no": {"state": "missing"}}
    gold = write(tmp_path / "g.jsonl", *[{"doc": d, "docClass": "c", "fields": fields} for d in ("x", "y")])
    good = {f"/f{i}": {"value": f"v{i}" if i else "wrong", "confidence": 0.9 if i else 0.3} for i in range(3)}
    pred = write(tmp_path / "p.jsonl", {"doc": "x", "docClass": "c", "fields": good}, {"doc": "y", "fields": good | {"/no": {"value": "made up", "confidence": 0.8}}})
    out = str(tmp_path / "scores.json")
    assert cli.main(["score", "--golden", gold, "--predictions", pred, "--out", out]) == 0
    found = json.loads(Path(out).read_text())
    assert (found["corpus"]["tp"], found["corpus"]["fp"], found["corpus"]["fn"]) == (4, 3, 2)
    assert cli.main(["ci", "--scores", out, "--min-f1", "0.5", "--max-ece", "1"]) == 0
    assert cli.main(["ci", "--scores", out, "--min-f1", "0.99", "--max-ece", "1"]) == 1
    assert cli.main(["ci", "--scores", out, "--min-f1", "", "--max-ece", "1"]) == 2
    assert cli.main(["ci", "--scores", out, "--min-f1", "0.5", "--max-ece", "1", "--baseline", " "]) == 2
    assert cli.main(["calibrate", "--scores", out]) == 0
    assert cli.main(["report", "--scores", out, "--out", str(tmp_path / "r")]) == 0
    assert "f1" in (tmp_path / "r/report.txt").read_text()
    flat = write(tmp_path / "flat.json", {"version": 1, "corpus": {"f1": 1.0, "ece": 0.0}, "points": [{"confidence": 0.5, "correct": True}]})
    assert cli.main(["calibrate", "--scores", flat]) == 3
    manifest = write(tmp_path / "m.json", {"full": "a", "variants": {"a": "scores.json", "b": "scores.json"}})
    assert cli.main(["curves", "--manifest", manifest]) == 0
    pred = write(tmp_path / "q.jsonl", *[{"doc": d, "docClass": "c", "repeat": r, "fields": {"/no": {"value": "z", "confidence": 0.6}} if d == "x" else {}} for d in ("x", "y") for r in (1, 2)])
    assert cli.main(["fabrication", "--golden", gold, "--predictions", pred, "--resamples", "50", "--out", str(tmp_path / "f.json")]) == 0
    f = json.loads((tmp_path / "f.json").read_text())
    assert f["pooled"]["estimate"] == 0.5
    assert f["perClass"] == [{"docClass": "c", "absentCells": 2}]
    assert "see probe table" in report.fabrication_table({"a1": f})
    lost = write(tmp_path / "one.jsonl", {"doc": "x", "docClass": "c", "fields": {}})
    assert cli.main(["score", "--golden", gold, "--predictions", lost, "--out", out]) == 2
    assert cli.main(["nonsense"]) == 2


def test_figures():
    assert report.reliability_svg([{"mean_confidence": 0.5, "accuracy": 0.4}], [{"mean_confidence": 0.5, "lo": 0.2, "hi": 0.7}]).count("<circle") == 1
    assert "<circle" in report.risk_coverage_svg([{"coverage": 0, "error": 0}, {"coverage": 1, "error": 0.2}])
    assert report.stamp_label({"status": "mixed", "values": ["a", "b"], "missing": 1}).startswith("mixed")
    assert score.NoNumber and report.bars_svg([("a", 0.1, 0.05, 0.2)]).startswith("<svg")
