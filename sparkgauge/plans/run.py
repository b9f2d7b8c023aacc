"""A resumable run: planned documents times repeats against an extraction callable.

Units that the log has are never called again.  Units run in waves, a wave's calls spread over executors; after each
wave outcomes are appended to the log in planned order and the breaker looks at the streak, so at most one wave runs
beyond the point where it opens.  What the driver holds is a wave's outcomes.
"""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import runlog
from ..operators.adapters import run_extraction
from ..operators.requests import Fatal, check_fields
from ..sources import checkpoint, jsonl
from ..sources.checkpoint import Lease, durable_append, durable_write
from ..sources.sinks import write_json


@dataclass(frozen=True)
class RunConfig:
    golden: str
    adapter: str
    out: str
    repeats: int = 1
    retries: int = 2
    #: Contract failures in a row that pause the run; by default as many as repeats.
    limit: int | None = None
    wave: int = 64
    live: bool = False
    usd_per_unit: float | None = None
    spend_confirmed: bool = False
    resume_open: bool = False
    #: What the whole run is expected to cost, from which rates, and as of which day.
    expected_usd: float | None = None
    pricing_basis: str | None = None
    pricing_as_of: str | None = None
    #: Take over the folder of a run whose process is gone; go on with a log that other code began.
    recover_lease: bool = False
    allow_drift: bool = False

    def fingerprint(self, documents: str) -> str:
        keep = {k: v for k, v in asdict(self).items() if k in ("adapter", "repeats", "retries", "limit", "live")}
        return hashlib.sha256(json.dumps(keep, sort_keys=True).encode() + documents.encode()).hexdigest()


def code_state(folder: str | Path = ".") -> str:
    """The commit, or that the tree has changes or is none."""
    git = lambda *a: subprocess.run(["git", "-C", str(folder), *a], capture_output=True, text=True)
    head = git("rev-parse", "HEAD")
    if head.returncode:
        return "none"
    return head.stdout.strip() + ("+changes" if git("status", "--porcelain").stdout.strip() else "")


def fit_to_record(extract: Callable[[dict], dict]) -> Callable[[dict], dict]:
    """The same, with answers that may not be recorded as contract failures."""

    def checked(unit: dict) -> dict:
        fields = extract(unit)
        check_fields(fields)
        return fields

    return checked


def _planned(goldens: DataFrame) -> DataFrame:
    return goldens.groupBy("doc_class", "doc").agg(F.min("doc_ord").alias("doc_ord"))


#: What tells a unit, with its place.
UNIT = ["doc_class", "doc", "repeat", "doc_ord"]
_OUTCOME = "doc_class string, doc string, repeat int, doc_ord long, availability string, request_attempts int, response string, error string"


def mapped(spark: SparkSession, outcomes: list[Row], mapper: Callable[[DataFrame, list[str]], tuple[DataFrame, DataFrame]]) -> list[Row]:
    """A wave's raw answers as fields, by an adapter's mapper; what it can't read is a contract failure.  Answers are there already: no call is made again."""
    frame = spark.createDataFrame([tuple(r[c] for c in [*UNIT, "availability", "request_attempts", "response", "error"]) for r in outcomes], _OUTCOME)
    fields, failed = mapper(frame.filter("availability = 'completed'").select(*UNIT, "response"), UNIT)
    found: dict[tuple, dict] = {}
    for r in fields.collect():
        value = {"value": json.loads(r.value_json)}
        found.setdefault(tuple(r[c] for c in UNIT), {})[r.field] = value if r.confidence is None else value | {"confidence": r.confidence}
    lost = {tuple(r) for r in failed.select(*UNIT).collect()}
    out = []
    for r in outcomes:
        unit, said = tuple(r[c] for c in UNIT), r.asDict()
        if r.availability == "completed":
            try:
                if unit in lost:
                    raise ValueError("the answer holds no fields")
                check_fields(found.get(unit, {}))
                said["response"] = json.dumps(found.get(unit, {}))
            except ValueError as e:
                said |= {"availability": "contract_failure", "response": None, "error": str(e)}
        out.append(Row(**said))
    return out


def run(spark: SparkSession, config: RunConfig, extract: Callable[[dict], dict], state: str | None = None, bodies: DataFrame | None = None,
        mapper: Callable[[DataFrame, list[str]], tuple[DataFrame, DataFrame]] | None = None) -> dict:
    """Run what is left; returns the health record.  ``extract(unit)`` answers fields by pointer, each ``{value, confidence?}``.

    With ``bodies`` (``doc_class, doc`` and what a request needs) a unit carries them, and with a ``mapper`` answers are a service's own, read by it.  Refused before any call: a live run without confirmed spend or from a tree with changes, a log of other code.
    """
    out = Path(config.out)
    out.mkdir(parents=True, exist_ok=True)
    state = code_state() if state is None else state
    if config.live and ((config.usd_per_unit is None and config.expected_usd is None) or not config.spend_confirmed):
        raise ValueError("run: a live run needs a price and confirmed spend")
    if config.live and state.endswith("+changes"):
        raise ValueError("run: a live run needs a clean tree")
    planned = _planned(jsonl.read_goldens(spark, config.golden)).cache()
    digest = planned.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "doc_class", "doc"))), "\n"), 256)).first()[0]
    mark, limit = config.fingerprint(digest), config.limit or config.repeats
    log_path = out / "run.checkpoint.jsonl"
    with Lease(out, mark, config.recover_lease) as lease:
        log = checkpoint.load(log_path, mark)
        if log is None:
            checkpoint.start(log_path, mark, datetime.now(UTC).isoformat(), state)
            log = checkpoint.load(log_path, mark)
        elif log.header["codeState"] != state and not config.allow_drift:
            raise ValueError("run: the log was begun by other code")
        elif log.torn:
            # the last line was cut off by a crash: leave it out for good
            text = log_path.read_text()
            durable_write(log_path, text[: text.rstrip("\n").rfind("\n") + 1])
        streak = 0
        for r in log.records:
            streak = streak + 1 if r["availability"] == "contract_failure" else 0
        if log.events and log.events[-1]["kind"] == "circuit_open":
            if not config.resume_open:
                return _finish(spark, config, planned, mark, limit, "paused")
            durable_append(log_path, {"kind": "manual_resume", "at": datetime.now(UTC).isoformat()}, lease)
            streak = 0
        write_json(out / "spend-preflight.json", preflight(config, planned.count(), len(log.records)))
        done = spark.createDataFrame([(r["docClass"], r["doc"], r["repeat"]) for r in log.records], "doc_class string, doc string, repeat int")
        left = checkpoint.pending(planned, config.repeats, done).join(planned, ["doc_class", "doc"]).orderBy("repeat", "doc_ord").cache()
        units = left.toLocalIterator(prefetchPartitions=True)
        while wave := [u for _, u in zip(range(config.wave), units, strict=False)]:
            rows = spark.createDataFrame(wave, left.schema)
            if bodies is not None:
                rows = rows.join(bodies, ["doc_class", "doc"])
            rows = rows.repartition(min(len(wave), spark.sparkContext.defaultParallelism))
            outcomes = run_extraction(rows, extract if mapper else fit_to_record(extract), config.retries).select(*UNIT, "availability", "request_attempts", "response", "error").collect()
            for r in sorted(mapped(spark, outcomes, mapper) if mapper else outcomes, key=lambda r: (r.repeat, r.doc_ord)):
                if r.availability == "fatal":
                    continue
                durable_append(log_path, {
                    "kind": "prediction", "doc": r.doc, "docClass": r.doc_class, "repeat": r.repeat, "fields": json.loads(r.response) if r.response else {},
                    "availability": r.availability, "requestAttempts": r.request_attempts, "transportRetries": r.request_attempts - 1, **({"error": r.error} if r.error else {}),
                }, lease)
                streak = streak + 1 if r.availability == "contract_failure" else 0
            if ends := [r.error for r in outcomes if r.availability == "fatal"]:
                # what was answered is in the log; these units are left for the run after the cause is mended
                raise Fatal(f"run: {ends[0]}")
            if streak >= limit:
                durable_append(log_path, {"kind": "circuit_open", "streak": streak, "at": datetime.now(UTC).isoformat()}, lease)
                return _finish(spark, config, planned, mark, limit, "paused")
        return _finish(spark, config, planned, mark, limit, "complete")


def _finish(spark: SparkSession, config: RunConfig, planned: DataFrame, mark: str, limit: int, status: str) -> dict:
    """Predictions by repeat in golden order (files of other repeats go), health and metadata."""
    out = Path(config.out)
    log = checkpoint.load(out / "run.checkpoint.jsonl", mark)
    order = {(r.doc_class, r.doc): r.doc_ord for r in planned.toLocalIterator()}
    rows = sorted(log.records, key=lambda r: (r["repeat"], order[r["docClass"], r["doc"]]))
    for old in out.glob("predictions*.jsonl"):
        old.unlink()
    for k in range(1, config.repeats + 1):
        text = "".join(json.dumps(r) + "\n" for r in rows if r["repeat"] == k)
        durable_write(out / f"predictions.repeat-{k:03}.jsonl", text)
        if config.repeats == 1:
            durable_write(out / "predictions.jsonl", text)
    frame = spark.createDataFrame([(r["repeat"], i, r["availability"]) for i, r in enumerate(rows)], "repeat int, seq int, availability string")
    health = runlog.health(frame, len(order) * config.repeats, limit, ["seq"]) | {"status": status, "adapter": config.adapter}
    write_json(out / "run-health.json", health)
    durable_write(out / "run-events.jsonl", "".join(json.dumps(e) + "\n" for e in log.events))
    state, meta = log.header["codeState"], {"startedAt": log.header["startedAt"], "completedAt": datetime.now(UTC).isoformat() if status == "complete" else None}
    gaps = [k for k, v in (meta | {"spend": config.usd_per_unit if config.expected_usd is None else config.expected_usd, "code.commit": None if state == "none" or state.endswith("+changes") else state}).items() if v is None]
    write_json(out / "run-manifest.json", {
        "formatVersion": 1, "adapter": config.adapter, "fingerprint": mark, "code": {"commit": state.removesuffix("+changes"), "dirty": state.endswith("+changes")},
        "goldenSha256": hashlib.sha256(Path(config.golden).read_bytes()).hexdigest() if Path(config.golden).is_file() else None, "planned": len(order) * config.repeats, "status": status, "missingFields": gaps,
    })
    spend = json.loads((out / "spend-preflight.json").read_text()) if (out / "spend-preflight.json").is_file() else None
    write_json(out / "run-meta.json", {"fingerprint": mark, "spendPreflight": spend, "startedAt": log.header["startedAt"], "completedAt": datetime.now(UTC).isoformat() if status == "complete" else None, "codeState": log.header["codeState"], "config": asdict(config), "events": log.events})
    return health


def preflight(config: RunConfig, documents: int, restored: int) -> dict:
    """What is left to run and what it is expected to cost, before any call; costs are null without a price."""
    planned = documents * config.repeats
    whole = config.expected_usd if config.expected_usd is not None else None if config.usd_per_unit is None else config.usd_per_unit * planned
    left = max(0, planned - restored)
    return {
        "mode": "live" if config.live else "recorded", "adapter": config.adapter, "documents": documents, "repeats": config.repeats, "plannedUnits": planned, "remainingUnits": left, "retriesPerUnit": config.retries,
        "expectedUsd": whole, "expectedRemainingUsd": None if whole is None else whole * left / max(1, planned), "pricingBasis": config.pricing_basis, "pricingAsOf": config.pricing_as_of,
    }


def check_pricing(expected: str | None, basis: str | None, as_of: str | None) -> tuple[float, str, str]:
    """A live run's price as its flags say it; an error if one is missing or no price."""
    try:
        usd = float(expected or "")
    except ValueError:
        usd = 0.0
    if not 0 < usd < float("inf"):
        raise ValueError("run: a live run needs --expected-spend-usd above zero")
    if not (basis or "").strip():
        raise ValueError("run: a live run needs --pricing-basis")
    try:
        day = datetime.strptime(as_of or "", "%Y-%m-%d").strftime("%Y-%m-%d")
    except ValueError:
        day = None
    if day is None or day != as_of:
        raise ValueError("run: a live run needs --pricing-as-of as YYYY-MM-DD")
    return usd, basis.strip(), as_of


def spend_preflight(planned: int, restored: int, usd_per_unit: float) -> str:
    left = runlog.spend_left(planned, restored, usd_per_unit)
    return f"{planned - restored} of {planned} units left, expected spend ${left:.2f}"
