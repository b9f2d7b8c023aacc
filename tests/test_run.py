import json

import pytest

from sparkgauge import cli
from sparkgauge.plans import run as runs


@pytest.fixture
def golden(tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text("".join(json.dumps({"doc": d, "docClass": "c", "fields": {"/a": {"state": "present", "value": "v"}}}) + "\n" for d in "pqrst"))
    return str(path)


def test_run_pauses_resumes_and_never_calls_twice(spark, tmp_path, golden):
    calls = tmp_path / "calls"
    calls.mkdir()

    def extract(unit, broken=frozenset("rs")):
        with (calls / f"{unit['doc']}-{unit['repeat']}").open("a") as f:
            f.write("x")
        if unit["doc"] in broken:
            raise ValueError("no object")
        return {"/a": {"value": "v", "confidence": 0.9}}

    config = runs.RunConfig(golden, "chat", str(tmp_path / "out"), repeats=1, limit=2, wave=2)
    health = runs.run(spark, config, extract, "c1")
    # waves of two: p q | r s, then the breaker
    assert (health["status"], health["aggregate"]["attempted"], health["consecutiveContractFailures"]) == ("paused", 4, 2)
    assert runs.run(spark, config, extract, "c1")["aggregate"]["attempted"] == 4
    with pytest.raises(ValueError, match="other code"):
        runs.run(spark, config, extract, "c2")
    log = tmp_path / "out/run.checkpoint.jsonl"
    log.write_text(log.read_text() + '{"kind": "pre')
    done = runs.run(spark, runs.RunConfig(golden, "chat", str(tmp_path / "out"), repeats=1, limit=2, wave=2, resume_open=True), extract, "c1")
    assert (done["status"], done["aggregate"]["completed"], done["aggregate"]["contract_failures"]) == ("complete", 3, 2)
    assert all(p.read_text() == "x" for p in calls.iterdir())
    lines = (tmp_path / "out/predictions.repeat-001.jsonl").read_text().splitlines()
    assert [json.loads(x)["doc"] for x in lines] == list("pqrst")
    assert (tmp_path / "out/predictions.jsonl").exists()


def test_live_runs_need_confirmation(spark, tmp_path, golden):
    with pytest.raises(ValueError, match="confirmed"):
        runs.run(spark, runs.RunConfig(golden, "chat", str(tmp_path), live=True), dict, "c")
    with pytest.raises(ValueError, match="clean"):
        runs.run(spark, runs.RunConfig(golden, "chat", str(tmp_path), live=True, usd_per_unit=1, spend_confirmed=True), dict, "c+changes")
    assert "$6.00" in runs.spend_preflight(10, 4, 1.0)


def test_verbs(spark, tmp_path, golden, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "fx").mkdir()
    for d in "pqrst":
        (tmp_path / f"fx/{d}.json").write_text(json.dumps({"/a": {"value": "v"}}))
    assert cli.main(["run", "--golden", golden, "--adapter", "stated", "--fixtures", str(tmp_path / "fx"), "--out", str(tmp_path / "o")]) == 0
    predictions = str(tmp_path / "o/predictions.jsonl")
    assert cli.main(["dataset", "--golden", golden, "--predictions", predictions, "--arm", "a", "--out", str(tmp_path / "d")]) == 0
    deny = tmp_path / "deny"
    deny.write_text('"arm":"a"\n')
    assert cli.main(["dataset", "--golden", golden, "--predictions", predictions, "--arm", "a", "--denylist", str(deny), "--out", str(tmp_path / "d2")]) == 1
    pages = tmp_path / "pages.json"
    pages.write_text("".join(json.dumps({"doc_class": "c", "doc": d, "pages": 3}) + "\n" for d in "pqrst"))
    assert cli.main(["corpora", "--golden", golden, "--pages", str(pages), "--out", str(tmp_path / "c")]) == 0
    assert json.loads((tmp_path / "c/c.schema.json").read_text())["required"] == ["a"]
    leaf = {"type": ["string", "null"]}
    for c in ("a", "b"):
        (tmp_path / f"{c}.schema.json").write_text(json.dumps({"properties": {f"{c}{i}": leaf for i in range(4)}}))
    assert cli.main(["probes", "--schemas", str(tmp_path), "--out", str(tmp_path / "p")]) == 0
    assert len(json.loads((tmp_path / "p/probes.json").read_text())["probes"]["a"]) == 3


def test_probe_verbs(spark, tmp_path, golden, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    leaf = {"type": ["string", "null"]}
    for c, names in (("c", ["own", "mine", "more"]), ("b", ["due_date", "payee", "memo"])):
        (tmp_path / f"{c}.schema.json").write_text(json.dumps({"properties": dict.fromkeys(names, leaf)}))
    out = tmp_path / "p"
    assert cli.main(["probes", "--schemas", str(tmp_path), "--golden", golden, "--out", str(out)]) == 0
    lines = [json.loads(x) for x in (out / "golden.c.probe.jsonl").read_text().splitlines()]
    assert [x["doc"] for x in lines] == list("pqrst")
    assert all(set(x["fields"]) == {"/due_date", "/payee", "/memo"} for x in lines)
    texts = tmp_path / "texts.json"
    texts.write_text(json.dumps({"doc_class": "c", "doc": "p", "text": "The Due Date is"}) + "\n")
    assert cli.main(["probes-verify", "--probes", str(out / "probes.json"), "--texts", str(texts), "--out", str(tmp_path / "hits.json")]) == 1
    assert json.loads((tmp_path / "hits.json").read_text())["hits"][0]["field"] == "due_date"
    sheet = (out / "WORKSHEET.md").read_text().splitlines()
    sheet = [line[:-3] + " y |" if "| p | payee" in line else line for line in sheet]
    (tmp_path / "W.md").write_text("\n".join(sheet))
    assert cli.main(["probes-strike", "--probes", str(out / "probes.json"), "--worksheet", str(tmp_path / "W.md"), "--out", str(tmp_path / "s")]) == 0
    assert {p["field"] for p in json.loads((tmp_path / "s/probes.json").read_text())["probes"]["c"]} == {"due_date", "memo"}
    assert json.loads((tmp_path / "s/strikes.json").read_text())["struck"] == [{"docClass": "c", "field": "payee", "documents": ["p"]}]


def test_matrix_runs_and_scores_cells(spark, tmp_path, golden, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "golden.c.jsonl").write_text(open(golden).read())
    for arm, docs in (("a1", "pqrst"), ("a2", "")):
        (tmp_path / "fx" / arm).mkdir(parents=True)
        (tmp_path / "fx" / arm / "none.json").write_text("{}")
        for d in docs:
            (tmp_path / "fx" / arm / f"{d}.json").write_text(json.dumps({"/a": {"value": "v", "confidence": 0.9}}))
    config, docs = tmp_path / "m.json", tmp_path / "docs.json"
    config.write_text(json.dumps({"formatVersion": 1, "capBranch": "unresolved", "armModes": [{"id": a, "adapter": "stated", "usdPerUnit": 0.1} for a in ("a2", "a1")], "classes": ["c"], "repeats": 1, "passes": ["main"]}))
    docs.write_text("".join(json.dumps({"doc_class": "c", "pass": "main", "doc": d}) + "\n" for d in "pqrst"))
    code = cli.main(["matrix", "--config", str(config), "--documents", str(docs), "--goldens", str(tmp_path), "--fixtures", str(tmp_path / "fx"), "--out", str(tmp_path / "o")])
    done = json.loads((tmp_path / "o/matrix-manifest.json").read_text())
    assert code == 1
    assert {c["cell"]: c["status"] for c in done["cells"]} == {"a2/c/main": "failed_or_paused", "a1/c/main": "completed"}
    assert json.loads((tmp_path / "o/a1/c/main/scores.json").read_text())["meanOverRepeats"]["f1"] == 1.0
    assert (tmp_path / "o/a1/c/main/run-events.jsonl").exists()


def test_same_bytes(tmp_path):
    from sparkgauge.sources.sinks import content_digest

    for name, parts in (("a", ("1\n2\n", "3\n")), ("b", ("1\n", "2\n3\n")), ("c", ("2\n1\n", "3\n"))):
        (tmp_path / name).mkdir()
        for i, text in enumerate(parts):
            (tmp_path / name / f"part-{i:05}").write_text(text)
    assert content_digest(tmp_path / "a") == content_digest(tmp_path / "b") != content_digest(tmp_path / "c")
