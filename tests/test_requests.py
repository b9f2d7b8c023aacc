import base64
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgauge import cli
from sparkgauge.functions import values
from sparkgauge.operators import adapters, requests
from sparkgauge.plans import matrix, report
from sparkgauge.sources import discovery, sinks
from sparkgauge.sources.jsonl import InputError


def test_bodies(spark):
    content = bytes(range(256)) * 3
    schema = json.dumps({"type": "object", "properties": {"a": {"type": ["string", "null"]}}})
    rows = spark.createDataFrame([(bytearray(content), schema)], "content binary, schema string")
    c, s = F.col("content"), F.col("schema")
    body = lambda e: json.loads(rows.select(e).first()[0])
    data = base64.b64encode(content).decode()
    chat = body(requests.chat_body(c, s, "m", "Do.", structured=True, without=("logprobs",)))
    assert chat["messages"][0]["content"][0]["file"]["file_data"] == "data:application/pdf;base64," + data
    assert chat["messages"][0]["content"][1] == {"type": "text", "text": "Do.\n\nJSON Schema:\n" + schema}
    assert chat["response_format"]["json_schema"] == {"name": "extraction", "strict": True, "schema": json.loads(schema)}
    assert (chat["model"], chat["temperature"], "logprobs" in chat) == ("m", 0, False)
    parts = body(requests.parts_body(c, s, "Do.", without=("temperature",)))
    assert parts == {"contents": [{"role": "user", "parts": [{"text": "Do.\n\nJSON Schema:\n" + schema}, {"inline_data": {"mime_type": "application/pdf", "data": data}}]}]}
    assert body(requests.parts_body(c, s, "Do.", True))["generationConfig"]["responseJsonSchema"] == json.loads(schema)
    assert body(requests.annotation_body(c, s, "m"))["document"]["document_url"].endswith(data)
    assert body(requests.job_body(F.lit("f1"), s)) == {"file_input": "f1", "configuration": {"extraction_target": "per_doc", "data_schema": json.loads(schema)}}
    assert body(requests.stated_body(c, s, F.lit("k"))) == {"schema": json.loads(schema), "options": {"doc_class": "k"}, "document": {"bytes_base64": data}}


@pytest.mark.parametrize(
    ("fields", "why"),
    [(None, "no usable"), ([], "no usable"), ({"/a": 3}, "not an object"), ({"/a": {}}, "no JSON value"), ({"/a": {"value": 1, "confidence": 1.5}}, "invalid confidence"),
     ({"/a": {"value": 1, "confidence": True}}, "invalid confidence"), ({"/a": {"value": math.nan}}, "serializable"), ({"/a": {"value": object()}}, "serializable")],
)
def test_fields_that_may_not_be_recorded(fields, why):
    with pytest.raises(ValueError, match=why):
        requests.check_fields(fields)
    requests.check_fields({"/a": {"value": None}, "/b": {"value": [1], "confidence": 0}})


def test_unfit_fields_are_contract_failures(spark):
    units = spark.createDataFrame([("good",), ("bad",)], "doc string")
    out = adapters.run_extraction(units, lambda u: {"fields": {"/a": {"value": 1} if u["doc"] == "good" else {}}}, check=True)
    assert {r.doc: (r.availability, r.error) for r in out.collect()} == {"good": ("completed", None), "bad": ("contract_failure", "field /a has no JSON value")}


def test_jobs_are_polled():
    states = iter(["RUNNING", "PENDING", "COMPLETED"])
    waits = []
    job = lambda status: {"id": "j", "status": status, "extract_result": {"a": 1}}
    ask = lambda **kw: requests.run_job(lambda: {"id": "f"}, lambda f: job("PENDING"), lambda j: job(next(states)), sleep=waits.append, **kw)
    assert ask() == {"a": 1}
    assert waits == [requests.POLL_EVERY_S] * 2
    states = iter(["RUNNING"] * 200)
    with pytest.raises(ValueError, match="still RUNNING after 90 polls"):
        ask()
    with pytest.raises(ValueError, match="after 0 polls"):
        ask(deadline=0.0)
    with pytest.raises(ValueError, match="ended FAILED"):
        requests.run_job(lambda: {"id": "f"}, lambda f: job("FAILED"), None)
    with pytest.raises(ValueError, match="no file id"):
        requests.run_job(dict, None, None)


def test_discovery(tmp_path):
    for name in ("golden.b.jsonl", "golden.a.jsonl", "golden.a.b.jsonl", "other.jsonl", "probes/golden.a.probe.jsonl", "a.schema.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    names = lambda paths: [str(p).removeprefix(f"{tmp_path}/") for p in paths]
    assert names(discovery.golden_files(tmp_path)) == ["golden.a.jsonl", "golden.b.jsonl"]
    assert names(discovery.golden_files(tmp_path, "probe")) == ["probes/golden.a.probe.jsonl"]
    with pytest.raises(InputError, match="no schema for class b"):
        discovery.class_schemas(tmp_path)
    for name in ("b/main/predictions.repeat-001.jsonl", "a/main/predictions.repeat-002.jsonl", "a/main/predictions.repeat-001.jsonl", "a/main/predictions.jsonl", "a/probe/predictions.repeat-001.jsonl"):
        (tmp_path / "arm" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "arm" / name).write_text("")
    assert names(discovery.prediction_files(tmp_path / "arm")) == [f"arm/{x}" for x in ("a/main/predictions.repeat-001.jsonl", "a/main/predictions.repeat-002.jsonl", "b/main/predictions.repeat-001.jsonl")]
    for ask in (lambda: discovery.golden_files(tmp_path / "arm"), lambda: discovery.prediction_files(tmp_path / "none")):
        with pytest.raises(InputError):
            ask()


def test_a_failed_cell_never_blocks_others(tmp_path):
    plan = [{"arm": a, "adapter": "x", "doc_class": "c", "pass": "main", "repeats": 2, "scorings": ["primary"], "expected_usd": 1.0} for a in ("a1", "a2", "a3")]
    corpus = lambda v: dict.fromkeys(matrix.METRICS, v)

    def score(cell, repeat, kind):
        if cell["arm"] == "a3":
            raise ValueError("no scores")
        return {"corpus": corpus(float(repeat)), "normalized": {"corpus": corpus(0.5)}}

    done = matrix.execute(plan, lambda c: 3 if c["arm"] == "a2" else 0, score, tmp_path, lambda c: {"commit": c["arm"], "missing": []})
    assert [c["status"] for c in done["cells"]] == ["completed", "failed_or_paused", "scoring_failed"]
    assert not done["validation"]["publicationReady"]
    assert done["validation"]["problems"] == ["a2/c/main: failed_or_paused", "a3/c/main: scoring_failed", "more than one commit"]
    cell = json.loads((tmp_path / "a1/c/main/scores.json").read_text())
    assert (cell["meanOverRepeats"]["f1"], cell["meanOverRepeatsNormalized"]["f1"], len(cell["repeats"])) == (1.5, 0.5, 2)
    assert json.loads((tmp_path / "matrix-manifest.json").read_text())["cells"] == done["cells"]
    assert len(json.loads((tmp_path / "cost-log.json").read_text())) == 3


def test_publication_tables():
    v = lambda x: {"estimate": x, "lo": x - 0.1, "hi": x + 0.1}
    arm = lambda name, c: {"arm": name, "macroF1": {"normalized": v(0.7)}, "fabrication": v(0.2), "usdPer1kPages": 2.0, "confidence": c, "perClassF1": {"k": {"normalized": v(0.6), "strict": v(0.5)}}}
    arms = [arm("a+x", {"kind": "unasked"}), arm("a", {"kind": "numeric", "stamp": "cal-2026.05-1", "ece": v(0.1), "brier": v(0.2), "errorAtCoverage90": v(0.3)}), arm("b", {"kind": "none"})]
    head = report.headline_table(arms).splitlines()
    assert [line.split()[0] for line in head[2:]] == ["a", "b", "a+x"]
    assert ["0.300 [0.200, 0.400]" in head[2], "none surfaced" in head[3], "not requested" in head[4]] == [True] * 3
    assert "—" in report.accuracy_table(arms, ["k", "other"])
    assert "$" not in report.accuracy_table(arms, ["k"]) + report.confidence_table(arms)
    assert "a (cal-2026.05-1)" in report.confidence_table(arms)
    assert "> grid" in report.effect_table([{"class": "k", "docs": 2, "fields": 5, "at75": 0.105, "at90": None}], "assumed")
    assert "0.084 [0.058, 0.114]" in report.noise_table([{"label": "all", "n": 196, "mean": 0.084, "p05": 0.058, "p95": 0.114}])


def test_own_addresses_may_leave(spark):
    rows = spark.createDataFrame([("a@own.org b",), ("a@else.org",)], "t string")
    assert [r.hit for r in sinks.sweep_hits(rows, F.col("t"), own_domain="own.org").collect()] == ["a@else.org"]


def test_over_cap_is_refused(spark):
    docs = spark.createDataFrame([("c", "d", 8), ("c", "e", 9)], "doc_class string, doc string, pages int")
    with pytest.raises(ValueError, match="c/e: 9 pages"):
        adapters.refuse_over_cap(docs)
    assert adapters.refuse_over_cap(docs.filter("pages < 9")).count() == 1


@pytest.mark.parametrize("text", ["1e3", "0x1", "", "nan", "1.", ".5", "+1"])
def test_thresholds_are_plain_decimals(text):
    with pytest.raises(ValueError):
        cli.number(text)
    assert (cli.number("-0.25"), cli.number(" 3 ")) == (-0.25, 3.0)


LEAVES = st.one_of(st.none(), st.booleans(), st.integers(-99, 9999), st.sampled_from(["$1,880.00", "1880", " A  b ", "a b", "2024-01-31", "1/31/2024", 'q"uo:te', "back\\slash", "x]", "é:"]))
TREES = st.recursive(LEAVES, lambda t: st.one_of(st.lists(t, max_size=3), st.dictionaries(st.sampled_from(["a", "b:c", '"', "~/"]), t, max_size=3)), max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=12))
def test_normal_containers_keep_shape_and_equality(spark, trees):
    """Strings change to their normal forms wherever they stand, nothing else does; so normalising only adds matches."""
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, j string").select("i", F.to_json(F.parse_json("j")).alias("j"))
    got = {r.i: json.loads(r.n) for r in rows.select("i", values.normal_container(F.lit("text"), F.col("j")).alias("n")).collect()}
    form = lambda t: " ".join(t.split()).lower() if isinstance(t, str) else [form(x) for x in t] if isinstance(t, list) else {k: form(x) for k, x in t.items()} if isinstance(t, dict) else t
    assert got == {i: form(t) for i, t in enumerate(trees)}
