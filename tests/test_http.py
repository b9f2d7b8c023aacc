"""Calls against a server on this machine."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sparkgauge import cli
from sparkgauge.functions.text import failure_kind
from sparkgauge.operators.requests import Fatal, run_job
from sparkgauge.plans import run as runs
from sparkgauge.sources import http


#: Tasks read it from their own environment, which is that of the session's start.
os.environ["SERVICE_KEY"] = "s3cret"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        self.answer(None)

    def do_POST(self):
        self.answer(self.rfile.read(int(self.headers.get("Content-Length") or 0)))

    def answer(self, body):
        server = self.server
        with server.lock:
            server.seen.append((self.command, self.path, dict(self.headers), body))
            status, text, headers = server.reply(self.command, self.path, body, len(server.seen))
        if status == "slow":
            time.sleep(text)
            status, text = 200, "{}"
        if status is None:
            self.connection.close()
            return
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        raw = text.encode()
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.lock, s.seen, s.reply = threading.Lock(), [], lambda *_: (200, "{}", {})
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def service(server, **more):
    return http.Service(f"http://127.0.0.1:{server.server_port}/v1/projects/mine/x?key=1".partition("?")[0], "SERVICE_KEY", **more)


def test_an_answer_and_what_was_sent(server):
    server.reply = lambda *_: (200, '{"a": 1}', {"api-version": "v" * 300, "openai-version": "w", "request-id": "r1"})
    client = http.Client(service(server))
    assert client.send(body={"x": "é"}) == {"a": 1}
    assert client.provenance == {"apiVersion": "v" * 200, "requestId": "r1"}
    method, _, headers, body = server.seen[0]
    assert (method, headers["Authorization"], headers["Content-Type"], json.loads(body)) == ("POST", "Bearer s3cret", "application/json", {"x": "é"})
    http.Client(service(server, auth="x-goog-api-key")).send("/jobs/1")
    method, path, headers, _ = server.seen[1]
    assert (method, path.rpartition("/x")[2], headers["X-Goog-Api-Key"]) == ("GET", "/jobs/1", "s3cret")
    assert not {"Authorization", "Content-Type"} & set(headers)
    http.Client(service(server)).send("/files", form=b"%PDF")
    assert b"%PDF" in server.seen[2][3]
    assert server.seen[2][2]["Content-Type"].startswith("multipart/form-data; boundary=")


@pytest.mark.parametrize(("status", "error"), [(408, ConnectionError), (425, ConnectionError), (429, ConnectionError), (500, ConnectionError), (503, ConnectionError), (401, Fatal), (402, Fatal), (403, Fatal), (407, Fatal), (400, ValueError), (404, ValueError), (422, ValueError), (302, ValueError)])
def test_statuses(spark, server, status, error):
    server.reply = lambda *_: (status, "private words", {"Location": "http://127.0.0.1:1/elsewhere"})
    with pytest.raises(error, match=f"{status} from") as e:
        http.Client(service(server)).send(body={})
    assert "private" not in str(e.value)
    assert "mine" not in str(e.value)
    assert "<gcp-project>" in str(e.value)
    # the same rule as the column's
    kind = {ConnectionError: "transport_failure", Fatal: "fatal", ValueError: "contract_failure"}[error]
    assert spark.range(1).select(failure_kind(F.lit(status))).first()[0] == kind


def test_no_answer_no_json_no_key(server, monkeypatch):
    server.reply = lambda *_: (None, "", {})
    with pytest.raises(ConnectionError, match="no answer"):
        http.Client(service(server)).send(body={})
    server.reply = lambda *_: (200, "<html>", {})
    with pytest.raises(ValueError, match="no JSON"):
        http.Client(service(server)).send(body={})
    monkeypatch.delenv("SERVICE_KEY")
    with pytest.raises(Fatal, match="SERVICE_KEY"):
        http.Client(service(server)).send(body={})


def test_the_deadline_is_of_all_calls(server):
    server.reply = lambda *_: ("slow", 3.0, {})
    began = time.monotonic()
    with pytest.raises(ConnectionError):
        http.Client(service(server, deadline=0.3)).send(body={})
    assert time.monotonic() - began < 2
    client = http.Client(service(server, deadline=0.2))
    with pytest.raises(ConnectionError, match="deadline"):
        client.wait(5)
    with pytest.raises(ConnectionError, match="deadline"):
        client.send()


def test_a_wait_can_be_aborted(server):
    client = http.Client(service(server))
    threading.Timer(0.1, client.abort).start()
    began = time.monotonic()
    with pytest.raises(ConnectionError, match="aborted"):
        client.wait(30)
    assert time.monotonic() - began < 5


def test_jobs_upload_create_and_poll(server):
    polls = iter(["PENDING", "RUNNING", "COMPLETED"])

    def reply(method, path, body, n):
        if path.endswith("/files"):
            return 200, '{"id": "f7"}', {}
        if path.endswith("/jobs"):
            assert json.loads(body)["file_input"] == "f7"
            return 200, '{"id": "j1", "status": "PENDING"}', {}
        return 200, json.dumps({"id": "j1", "status": next(polls), "extract_result": {"total": 3}}), {}

    server.reply = reply
    found = http.jobs(service(server), every=0.01)({"content": bytearray(b"%PDF"), "body": '{"file_input": "@file"}'})
    assert found == {"extract_result": {"total": 3}}
    assert [p.rpartition("/x")[2] for _, p, *_ in server.seen] == ["/files", "/jobs", "/jobs/j1", "/jobs/j1", "/jobs/j1"]
    with pytest.raises(ValueError, match="still"):
        run_job(lambda: {"id": "f"}, lambda f: {"id": "j", "status": "RUNNING"}, lambda j: {"id": "j", "status": "RUNNING"}, polls=2, every=0.0)


def golden(tmp_path, docs="pqr"):
    (tmp_path / "pdfs").mkdir()
    for d in docs:
        (tmp_path / "pdfs" / f"{d}.pdf").write_bytes(b"%PDF " + d.encode())
    path = tmp_path / "g.jsonl"
    path.write_text("".join(json.dumps({"doc": f"{d}.pdf", "docClass": "c", "fields": {"/a": {"state": "present", "value": d}}}) + "\n" for d in docs))
    (tmp_path / "s.json").write_text('{"type": "object", "properties": {"a": {"type": ["string", "null"]}}}')
    (tmp_path / "m.json").write_text(json.dumps({"class": "c", "calTestGoldenHash": "0"}))
    return path


def live(server, tmp_path, adapter, *more):
    return cli.main([
        "run", "--golden", str(tmp_path / "g.jsonl"), "--adapter", adapter, "--docs", str(tmp_path / "pdfs"), "--out", str(tmp_path / "o"), "--live", "--url", service(server).url, "--key-env", "SERVICE_KEY",
        "--schema", str(tmp_path / "s.json"), "--model", "m1", "--confirm-spend", "--expected-spend-usd", "3", "--pricing-basis", "list", "--pricing-as-of", "2026-02-03", "--cal-test-manifest", f"c={tmp_path / 'm.json'}",
        "--commit-sha", "abc", *more,
    ])


def test_a_live_run_reaches_the_service(spark, server, tmp_path):
    golden(tmp_path)
    failed = set()

    def reply(method, path, body, n):
        doc = body.decode().partition("base64,")[2].partition('"')[0]
        if not failed:
            failed.add(doc)
            return 503, "", {}
        return 200, json.dumps({"choices": [{"message": {"content": json.dumps({"a": doc, "n": None})}, "logprobs": {"content": [{"token": "x", "logprob": -0.1}]}}], "model": "m1"}), {}

    server.reply = reply
    assert live(server, tmp_path, "chat", "--repeat", "2") == 0
    rows = [json.loads(x) for k in (1, 2) for x in (tmp_path / f"o/predictions.repeat-00{k}.jsonl").read_text().splitlines()]
    assert [(r["doc"], r["repeat"], r["availability"], set(r["fields"])) for r in rows] == [(f"{d}.pdf", k, "completed", {"/a", "/n"}) for k in (1, 2) for d in "pqr"]
    assert sorted(r["requestAttempts"] for r in rows) == [1, 1, 1, 1, 1, 2]
    assert len(server.seen) == 7
    assert json.loads(server.seen[0][3])["model"] == "m1"
    assert 0 < rows[0]["fields"]["/a"]["confidence"] < 1


def test_an_answer_that_no_mapper_reads_is_a_contract_failure(spark, server, tmp_path):
    golden(tmp_path)
    server.reply = lambda m, p, body, n: (200, json.dumps({"choices": [{"message": {"content": "sorry" if b"JVBERiBx" in body else '{"a": 1}'}}]}), {})
    assert live(server, tmp_path, "chat", "--limit", "5") == 0
    rows = [json.loads(x) for x in (tmp_path / "o/predictions.repeat-001.jsonl").read_text().splitlines()]
    assert [r["availability"] for r in rows] == ["completed", "contract_failure", "completed"]


def test_a_fatal_status_ends_the_run_and_keeps_what_was_answered(spark, server, tmp_path, capsys):
    golden(tmp_path)
    server.reply = lambda m, p, body, n: (401, "", {}) if b"JVBERiBx" in body else (200, '{"choices": [{"message": {"content": "{\\"a\\": 1}"}}]}', {})
    assert live(server, tmp_path, "chat") == 2
    assert "401" in capsys.readouterr().err
    log = [json.loads(x) for x in (tmp_path / "o/run.checkpoint.jsonl").read_text().splitlines()]
    assert [r["doc"] for r in log if r["kind"] == "prediction"] == ["p.pdf", "r.pdf"]
    server.seen.clear()
    server.reply = lambda *_: (200, '{"choices": [{"message": {"content": "{\\"a\\": 2}"}}]}', {})
    assert live(server, tmp_path, "chat") == 0
    assert len(server.seen) == 1
    assert runs.RunConfig("g", "chat", "o").recover_lease is False
