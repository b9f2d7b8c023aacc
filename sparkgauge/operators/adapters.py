"""Responses of extraction systems as long tables of fields.

A response arrives as JSON text.  Flattening unfolds a tree level by level; mappers differ in where
the answer lies and whether a confidence comes with it.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import failure_kind, logprob_confidence
from ..functions.values import valid_confidence
from .requests import Fatal, check_fields

#: Pages that one system takes at most.
PAGE_CAP = 8
#: Fixed value: the form of a served calibrator stamp.
STAMP = r"^cal-\d{4}\.\d{2}-\d+$"

#: Levels of a tree that are unfolded as columns; what lies deeper is walked text by text.
LEVELS = 6


def flatten(rows: DataFrame, key: list[str], column: str, outer: bool = False) -> DataFrame:
    """``<key>, field, value_json``: leaves of the JSON text in ``column`` by JSON Pointer; empty containers vanish.

    Primitives and null are leaves.  Levels are unfolded one after the other, each as a lateral join that leaves leaves as they are.
    Only texts that VARIANT refuses (an object repeats a key) and what lies below ``LEVELS`` are walked in Python, in Arrow batches, so neither rows nor levels have a limit.
    A null text has no leaves; with ``outer`` it gives one row with a null field.
    """
    spark = rows.sparkSession
    own = [F.col(k) for k in key]
    out = rows.select(*own, F.col(column).alias("_text"), F.try_parse_json(column).alias("_v"), F.lit("").alias("_path"))
    out = out if outer else out.filter("_text is not null")
    token = F.coalesce(F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
    for _ in range(LEVELS):
        down = out.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
        inner = F.col("pos").isNotNull()
        # of what has no members only empty containers go
        out = down.filter(inner | ~F.coalesce(F.to_json("_v").isin("{}", "[]"), F.lit(False))).select(
            *own, F.when(F.col("_v").isNull(), F.col("_text")).alias("_text"), F.when(inner, F.col("value")).otherwise(F.col("_v")).alias("_v"), F.when(inner, F.concat("_path", F.lit("/"), token)).otherwise(F.col("_path")).alias("_path")
        )
    out = out.select(*own, "_path", F.coalesce(F.to_json("_v"), F.col("_text")).alias("_json"), F.col("_text").isNotNull().alias("_raw"))
    none = F.col("_json").isNull()
    rest = ~none & (F.col("_raw") | F.col("_json").startswith("{") | F.col("_json").startswith("["))
    leaves = F.arrow_udf(_walked, "array<struct<field: string, raw: string>>")
    plain = F.array(F.struct(F.lit("").alias("field"), F.col("_json").alias("raw")))
    # a text that is a primitive as a whole has no field
    out = out.withColumn("_rest", rest).filter((F.col("_path") != "") | F.col("_rest") | none).withColumn("_walked", leaves(F.when(F.col("_rest"), F.col("_json"))))
    out = out.select(*own, "_path", "_rest", F.explode_outer(F.when(F.col("_rest"), F.col("_walked")).otherwise(plain)).alias("_leaf")).filter("_leaf is not null")
    value = F.when(F.col("_rest"), F.coalesce(F.to_json(F.try_parse_json("_leaf.raw")), F.col("_leaf.raw"))).otherwise(F.col("_leaf.raw"))
    return out.select(*own, F.when(F.col("_rest") | F.col("_leaf.raw").isNotNull(), F.concat("_path", "_leaf.field")).alias("field"), value.alias("value_json"))


def _walked(texts: pa.Array) -> pa.Array:
    """``flatten_text`` of those texts that are not null; the others cost nothing."""
    kind = pa.list_(pa.struct([("field", pa.string()), ("raw", pa.string())]))
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), kind)
    found = (flatten_text(t) for t in texts.to_pylist())
    return pa.array([None if leaves is None else [{"field": f, "raw": raw} for f, raw in leaves] for leaves in found], kind)


_TOKEN = re.compile(r'[ \t\r\n]*+(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![\w.+-])|(?:true|false|null)(?!\w)))')


def flatten_text(text: str | None) -> list[tuple[str, str]] | None:
    """Pointers and JSON texts of the leaves of the first value in ``text``, null if it isn't JSON; of a key that an object repeats the last value counts."""
    out, parts, seen, at, want = [], [], [], 0, "value"
    marks: list[tuple[str, int] | None] = []  # by level: the key that is being read, and the leaves before it
    gone: list[tuple[int, int]] = []  # leaves of values that a later one replaced
    while text is not None and (m := _TOKEN.match(text, at)):
        at, (mark, string, atom) = m.end(), m.groups()
        if want in ("key", "first key") and string:
            name = json.loads(string).encode("utf-8", "replace").decode()
            if marks[-1] is not None:
                seen[-1][marks[-1][0]] = (marks[-1][1], len(out))
            if name in seen[-1]:
                gone.append(seen[-1][name])
            marks[-1] = (name, len(out))
            parts[-1], want = name.replace("~", "~0").replace("/", "~1"), "colon"
            continue
        if want == "colon" and mark == ":":
            want = "value"
            continue
        if want == "next" and mark == ",":
            if seen[-1] is None:
                parts[-1] += 1
            want = "value" if seen[-1] is None else "key"
            continue
        if want in ("value", "first value") and mark in ("{", "["):
            seen.append({} if mark == "{" else None)
            marks.append(None)
            parts.append(0)
            want = "first key" if mark == "{" else "first value"
            continue
        if want in ("value", "first value") and not mark:
            if parts:
                out.append(("".join(f"/{p}" for p in parts), string or atom))
        elif mark in ("}", "]") and (want == "next" or want == ("first key" if mark == "}" else "first value")) and (seen[-1] is None) == (mark == "]"):
            seen.pop()
            marks.pop()
            parts.pop()
        else:
            return None
        if not seen:
            dropped = {i for a, b in gone for i in range(a, b)}
            return [x for i, x in enumerate(out) if i not in dropped] if dropped else out
        want = "next"
    return None


def _made(rows: DataFrame, name: str, value: F.Column) -> DataFrame:
    """Adds a column that comes out of a generator: what reads it doesn't make it again, and unlike a lambda's its code is compiled."""
    return rows.withColumn(name, F.explode(F.array(value)))


def repaired(rows: DataFrame, raw: F.Column, name: str) -> DataFrame:
    """Adds ``name``: ``text.repair_json`` of ``raw``, rung by rung as columns."""
    tries = ["_try0"]
    r = _made(rows, "_try0", raw)
    r = _made(r, "_found0", text.parsed_text(F.col("_try0")))
    for i, rung in enumerate(text.RUNGS):
        tries.append(f"_try{i + 1}")
        r = _made(r, tries[-1], F.when(F.col(f"_found{i}").isNull(), rung(F.col(tries[-2]))))
        r = _made(r, f"_found{i + 1}", F.coalesce(f"_found{i}", text.parsed_text(F.col(tries[-1]))))
    found = text.repair_result(F.col(f"_found{len(text.RUNGS)}"), [text.repair_text(F.col(t)) for t in tries])
    return r.withColumn(name, text.last_of_keys(found)).drop(*tries, *[f"_found{i}" for i in range(len(tries))])


def _with_answer(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``answer``: the text in ``column`` if it is a JSON object."""
    is_object = F.col(column).rlike("^[ \\t\\r\\n]*\\{") & F.try_parse_json(column).isNotNull()
    return _made(rows, "answer", F.when(is_object, F.col(column)))


def _fields(r: DataFrame, key: list[str], outer: bool = False) -> DataFrame:
    """Fields of the answers, with a confidence where there are tokens; with ``outer`` a row without an answer gives one with a null field."""
    if "_tokens" not in r.columns:
        return flatten(r, key, "answer", outer).withColumn("confidence", F.lit(None).cast("double"))
    fields = flatten(r, [*key, "_tokens"], "answer", outer)
    plain = F.when(F.col("value_json").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "value_json", F.lit("}")), "v string")["v"]).otherwise(F.col("value_json"))
    return fields.withColumn("confidence", F.when(F.col("field").isNotNull(), logprob_confidence(F.col("_tokens"), plain))).drop("_tokens")


def _split(r: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fields of the answers, and the keys of rows that have none."""
    return _fields(r.filter("answer is not null"), key), r.filter("answer is null").select(*key)


def _chat_answers(rows: DataFrame) -> DataFrame:
    schema = "choices array<struct<message: struct<content: string>, logprobs: struct<content: array<struct<token: string, logprob: double>>>>>, model string"
    r = _made(rows, "_choice", F.get(F.from_json("response", schema)["choices"], F.lit(0)))
    r = r.withColumn("_tokens", F.col("_choice.logprobs.content"))
    return _with_answer(repaired(r, F.col("_choice.message.content"), "_repaired"), "_repaired")


def _candidate_answers(rows: DataFrame) -> DataFrame:
    schema = "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>, modelVersion string"
    parts = F.array_join(F.get(F.from_json("response", schema)["candidates"], F.lit(0))["content"]["parts"]["text"], "")
    return _with_answer(repaired(rows, parts, "_repaired"), "_repaired")


def _annotation_answers(rows: DataFrame) -> DataFrame:
    r = _made(rows, "_note", F.try_variant_get(F.try_parse_json("response"), F.lit("$.document_annotation"), "variant"))
    note = F.col("_note")
    r = _made(r, "_given", F.coalesce(F.when(F.schema_of_variant(note) == "STRING", F.try_variant_get(note, F.lit("$"), "string")), F.to_json(note)))
    return _with_answer(r, "_given")


def _job_answers(rows: DataFrame) -> DataFrame:
    r = _made(rows, "_job", F.try_parse_json("response"))
    r = _made(r, "_given", F.coalesce(*[F.to_json(F.try_variant_get("_job", F.lit(p), "variant")) for p in ("$.extract_result", "$.data")]))
    return _with_answer(r, "_given")


#: Systems whose responses hold one answer: rows with ``response`` -> the same with ``answer``.
ANSWERS: dict[str, Callable[[DataFrame], DataFrame]] = {"chat": _chat_answers, "candidates": _candidate_answers, "annotation": _annotation_answers, "job": _job_answers}


def responses(kind: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """``<key>, field, value_json, confidence`` of a system in ``ANSWERS``; failed rows once, with a null field.  Rows are read once, where a mapper's two tables are two readings."""
    return _fields(ANSWERS[kind](rows), key, outer=True)


def chat_responses(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Chat completions (``response`` JSON text): fields with confidence from token logprobs, and failed keys.

    Tokens go along with their answer, as one more column of its leaves, so rows of one key, or of none, don't meet.
    """
    return _split(_chat_answers(rows), key)


def candidate_responses(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Responses whose text comes in parts of the first candidate; no confidence."""
    return _split(_candidate_answers(rows), key)


def annotation_responses(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Document annotations, an object or a JSON string; not repaired; no confidence."""
    return _split(_annotation_answers(rows), key)


def job_responses(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Completed extraction jobs: ``data`` or ``extract_result``; no confidence."""
    return _split(_job_answers(rows), key)


def stated_responses(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Native three-state fields by pointer; ``missing`` is left out; a broken field fails the whole response."""
    schema = "fields map<string, struct<state: string, value: variant, confidence: double>>"
    r = rows.withColumn("f", F.from_json("response", schema)["fields"])
    broken = F.exists(
        F.map_values("f"),
        lambda v: v.isNull()
        | ~F.coalesce(v["state"].isin("present", "null", "missing"), F.lit(False))
        | ((v["state"] == "present") != v["value"].isNotNull())
        | (v["confidence"].isNotNull() & ~valid_confidence(v["confidence"])),
    )
    r = r.withColumn("bad", F.coalesce(broken, F.lit(True)))
    cells = r.filter(~F.col("bad")).select(*key, F.explode("f").alias("field", "c")).filter("c.state <> 'missing'")
    value = F.when(F.col("c.state") == "null", F.lit("null")).otherwise(F.to_json("c.value"))
    return cells.select(*key, "field", value.alias("value_json"), F.col("c.confidence").alias("confidence")), r.filter("bad").select(*key)


#: Registry: id of a system -> its mapper, from (rows with ``response``, key columns) to (fields, failed).
REGISTRY: dict[str, Callable[[DataFrame, list[str]], tuple[DataFrame, DataFrame]]] = {
    "stated": stated_responses, "chat": chat_responses, "candidates": candidate_responses, "annotation": annotation_responses, "job": job_responses,
}


def get_adapter(name: str) -> Callable:
    if name not in REGISTRY:
        raise ValueError(f"unknown adapter {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def over_cap(documents: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    return documents.filter(F.col("pages") > cap)


def refuse_over_cap(documents: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """The documents, if none is beyond the cap; else an error that names the first."""
    first = over_cap(documents, cap).orderBy("doc_class", "doc").first()
    if first is not None:
        raise ValueError(f"{first.doc_class}/{first.doc}: {first.pages} pages, {cap} at most")
    return documents


def stamp_violations(records: DataFrame, expected: str | None = None) -> DataFrame:
    """Records whose calibrator stamp is none, malformed or not the expected one."""
    stamp = F.col("provenance.calibratorVersion")
    bad = stamp.isNull() | ~stamp.rlike(STAMP)
    return records.filter(bad | (stamp != F.lit(expected)) if expected else bad)


def classify_calls(calls: DataFrame) -> DataFrame:
    return calls.withColumn("failure", failure_kind(F.col("status")))


#: Seconds that a unit may take in all, and waits before the retries.
DEADLINE_S = 300.0
BACKOFF_S = (0.5, 1.0)


def run_extraction(units: DataFrame, extract: Callable[[dict], dict], retries: int = 2, deadline: float = DEADLINE_S,
                   backoff: tuple[float, ...] = BACKOFF_S, check: bool = False) -> DataFrame:
    """Call ``extract`` for each planned unit (any columns): ``availability, request_attempts, response, error``.

    ``extract`` raises ``ConnectionError`` for transport failures, which are tried again up to
    ``retries`` times within one deadline, ``ValueError`` for unusable answers, and ``Fatal`` (``availability`` is ``fatal``) where no further call makes sense; anything else stops the job.  With ``check``
    an answer's ``fields`` must be fit to be recorded.
    """
    names = units.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                attempts, state, answer, error = 0, "transport_failure", None, None
                end = time.monotonic() + deadline
                while attempts <= retries and state == "transport_failure":
                    if attempts:
                        wait = backoff[min(attempts, len(backoff)) - 1] if backoff else 0
                        if time.monotonic() + wait >= end:
                            break
                        time.sleep(wait)
                    attempts += 1
                    try:
                        # a call that never ends is left behind in its thread
                        caller = ThreadPoolExecutor(1)
                        found = caller.submit(extract, row).result(max(0.0, end - time.monotonic()))
                        if check:
                            check_fields(found.get("fields") if isinstance(found, dict) else None)
                        answer = json.dumps(found)
                        state, error = "completed", None
                    except (ConnectionError, TimeoutError) as e:
                        error = str(e) or "deadline"
                    except ValueError as e:
                        state, error = "contract_failure", str(e)
                    except Fatal as e:
                        state, error = "fatal", str(e)
                    finally:
                        caller.shutdown(wait=False)
                out.append(row | {"availability": state, "request_attempts": attempts, "response": answer, "error": error})
            yield pd.DataFrame(out, columns=[*names, "availability", "request_attempts", "response", "error"])

    return units.mapInPandas(run, f"{schema}, availability string, request_attempts int, response string, error string")


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded responses: ``name, response``."""
    return spark.read.text(f"{folder}/*.json", wholetext=True).select(
        F.regexp_extract("_metadata.file_path", "([^/]+)\\.json$", 1).alias("name"), F.col("value").alias("response")
    )
