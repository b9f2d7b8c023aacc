"""The matrix of arms, classes and passes: validation, cells with what each runs and is scored on, spend, score means.

With a confirmed cap, documents beyond it leave the primary scores of every arm, so arms stay paired: the capped adapter doesn't run them at
all, the others run them and get a second score on the whole set, as an appendix.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAP_BRANCHES = ("unresolved", "cap-confirmed", "cap-removed")
PASSES = ("main", "probe")
#: Flags that the planner sets; an arm's extra arguments may not.
RESERVED = (
    "--golden", "--docs", "--out", "--adapter", "--repeat", "--live", "--confirm-spend", "--resume-paused", "--recover-stale-lock", "--allow-commit-drift",
    "--mistral-cap-branch", "--expected-spend-usd", "--pricing-basis", "--pricing-as-of", "--cal-test-manifest", "--cal-test-golden-hash", "--commit-sha",
)
#: Kinds of scores.
PRIMARY, APPENDIX = "primary", "appendix"


@dataclass(frozen=True)
class Arm:
    id: str
    adapter: str
    usd_per_unit: float | None = None
    extra: tuple[str, ...] = ()
    pricing_basis: str | None = None
    pricing_as_of: str | None = None


@dataclass(frozen=True)
class Matrix:
    arms: tuple[Arm, ...]
    classes: tuple[str, ...]
    repeats: int = 3
    passes: tuple[str, ...] = PASSES
    cap_branch: str = "unresolved"
    capped_adapter: str = "annotation"
    excluded: tuple[tuple[str, str], ...] = field(default=())  # (class, document) beyond the cap
    manifests: tuple[tuple[str, str], ...] = field(default=())  # (class, split manifest)

    def validate(self, live: bool = False) -> None:
        if not self.arms or not self.classes or self.repeats < 1:
            raise ValueError("matrix: arms, classes and repeats are needed")
        for name, values in (("arm", [a.id for a in self.arms]), ("class", list(self.classes)), ("pass", list(self.passes))):
            if len(set(values)) != len(values):
                raise ValueError(f"matrix: {name} named twice")
        for c in self.classes:
            if "/" in c or "\\" in c or ".." in c or not c:
                raise ValueError(f"matrix: class {c!r} is no plain name")
        for p in self.passes:
            if re.search("refit|cal-?fit", p, re.IGNORECASE):
                raise ValueError(f"matrix: {p}: passes that fit again are no part of a matrix")
        if not self.passes or self.cap_branch not in CAP_BRANCHES or not set(self.passes) <= set(PASSES):
            raise ValueError("matrix: unknown cap branch or pass")
        for c, _ in self.manifests:
            if c not in self.classes:
                raise ValueError(f"matrix: a split manifest for {c}, which is no class of it")
        for a in self.arms:
            for flag in a.extra:
                if flag.split("=")[0] in RESERVED:
                    raise ValueError(f"matrix: {a.id}: {flag} is set by the plan")
            if live and a.usd_per_unit is None:
                raise ValueError(f"matrix: {a.id}: a live run needs a price")
            if live and a.adapter == self.capped_adapter and self.cap_branch == "unresolved":
                raise ValueError(f"matrix: {a.id}: the cap branch is unresolved")
        if live and (missing := set(self.classes) - {c for c, _ in self.manifests}):
            raise ValueError(f"matrix: a live run needs a split manifest for {min(missing)}")


def read_config(said: object, adapters: tuple[str, ...], excluded: tuple[tuple[str, str], ...] = ()) -> Matrix:
    """A matrix from its file; what is missing, of a wrong kind or unknown is an error before anything runs."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"matrix: {what}")

    need(isinstance(said, dict), "the config must be an object")
    need(said.get("formatVersion") == 1, "format version 1 is needed")
    texts = lambda x: isinstance(x, list) and x and all(isinstance(v, str) for v in x)
    need(said.get("capBranch") in CAP_BRANCHES, f"capBranch must be one of {', '.join(CAP_BRANCHES)}")
    need(texts(said.get("classes")), "classes must be names")
    need(type(said.get("repeats")) is int and said["repeats"] > 0, "repeats must be a whole number above zero")
    need(texts(said.get("passes")), "passes must be names")
    need(isinstance(said.get("armModes"), list) and said["armModes"], "armModes must name an arm at least")
    arms = []
    for a in said["armModes"]:
        need(isinstance(a, dict) and isinstance(a.get("id"), str) and re.fullmatch("[a-z0-9][a-z0-9-]*", a["id"]), "an arm's id must be lower-case letters, digits and dashes")
        need(a.get("adapter") in adapters, f"{a['id']}: unknown adapter {a.get('adapter')}")
        need("extraArgs" not in a or (isinstance(a["extraArgs"], list) and all(isinstance(v, str) for v in a["extraArgs"])), f"{a['id']}: extraArgs must be texts")
        spend = a.get("spend")
        if spend is not None:
            usd = spend.get("usdPerDocRepeat") if isinstance(spend, dict) else None
            fine = isinstance(usd, (int, float)) and not isinstance(usd, bool) and usd > 0 and str(spend.get("basis") or "").strip() and re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(spend.get("asOf")))
            need(bool(fine), f"{a['id']}: spend needs usdPerDocRepeat above zero, basis and asOf (YYYY-MM-DD)")
        price = spend or {"usdPerDocRepeat": a.get("usdPerUnit")}
        arms.append(Arm(a["id"], a["adapter"], price["usdPerDocRepeat"], tuple(a.get("extraArgs", ())), price.get("basis"), price.get("asOf")))
    manifests = said.get("calTestManifests") or {}
    need(isinstance(manifests, dict) and all(isinstance(v, str) for v in manifests.values()), "calTestManifests must be a path a class")
    m = Matrix(tuple(arms), tuple(said["classes"]), said["repeats"], tuple(said["passes"]), said["capBranch"], excluded=excluded, manifests=tuple(manifests.items()))
    m.validate()
    return m


def cells(spark: SparkSession, matrix: Matrix, documents: DataFrame, live: bool = False) -> DataFrame:
    """One row a cell: ``arm, adapter, doc_class, pass, repeats, docs, run_docs, golden, expected_usd, scorings, scoring_goldens, excluded``.

    ``documents(doc_class, pass, doc)``.  With a confirmed cap the capped adapter runs the capped golden set, and the primary score of every
    arm is on it; other arms get one on the whole set as an appendix.  ``scorings`` are the kinds of scores, ``scoring_goldens`` the golden
    set of each.  Expected spend counts the documents that a cell runs.
    """
    matrix.validate(live)
    arms = spark.createDataFrame([(i, a.id, a.adapter, a.usd_per_unit) for i, a in enumerate(matrix.arms)], "arm_ord int, arm string, adapter string, usd double")
    classes = spark.createDataFrame([(i, c) for i, c in enumerate(matrix.classes)], "class_ord int, doc_class string")
    passes = spark.createDataFrame([(i, p) for i, p in enumerate(matrix.passes)], "pass_ord int, pass string")
    out = spark.createDataFrame(list(matrix.excluded), "doc_class string, doc string").distinct()
    counts = documents.groupBy("doc_class", "pass").agg(F.count(F.lit(1)).alias("docs"))
    left = documents.join(out, ["doc_class", "doc"], "left_anti").groupBy("doc_class", "pass").agg(F.count(F.lit(1)).alias("capped_docs"))
    has_cap = out.groupBy("doc_class").agg(F.sort_array(F.collect_set("doc")).alias("over")).withColumn("capped_class", F.lit(matrix.cap_branch == "cap-confirmed"))
    # arms x classes x passes: tens of rows
    rows = arms.crossJoin(classes).crossJoin(passes).join(counts, ["doc_class", "pass"], "left").join(left, ["doc_class", "pass"], "left").join(has_cap, "doc_class", "left")
    capped = F.coalesce("capped_class", F.lit(False))
    runs_capped = capped & (F.col("adapter") == matrix.capped_adapter)
    run_docs = F.coalesce(F.when(runs_capped, F.col("capped_docs")).otherwise(F.col("docs")), F.lit(0))
    repeats = F.when(F.col("pass") == "probe", 1).otherwise(matrix.repeats)
    name = F.concat(F.lit("golden."), "doc_class", F.when(F.col("pass") == "probe", ".probe").otherwise(""))
    whole, short = F.concat(name, F.lit(".jsonl")), F.concat(name, F.lit(".capped.jsonl"))
    both = capped & ~runs_capped
    scorings = F.when(both, F.array(F.lit(PRIMARY), F.lit(APPENDIX))).otherwise(F.array(F.lit(PRIMARY)))
    goldens = F.when(both, F.array(short, whole)).when(runs_capped, F.array(short)).otherwise(F.array(whole))
    return rows.select(
        "arm", "adapter", "doc_class", "pass", repeats.alias("repeats"), F.coalesce("docs", F.lit(0)).alias("docs"), run_docs.alias("run_docs"),
        F.when(runs_capped, short).otherwise(whole).alias("golden"), (F.col("usd") * run_docs * repeats).alias("expected_usd"), scorings.alias("scorings"),
        goldens.alias("scoring_goldens"), F.when(capped, F.col("over")).otherwise(F.array().cast("array<string>")).alias("excluded"), "arm_ord", "class_ord", "pass_ord",
    ).orderBy("arm_ord", "class_ord", "pass_ord")


def golden_path(name: str, corpora: str | Path, out: str | Path) -> Path:
    """Where a cell's golden set lies: capped ones are derived under ``out``, those of probes have a folder of their own."""
    if name.endswith(".capped.jsonl"):
        return Path(out) / "derived" / name
    return Path(corpora) / "probes" / name if name.endswith(".probe.jsonl") else Path(corpora) / name


def run_args(cell: dict, matrix: Matrix, corpora: str | Path, docs: str | Path, out: str | Path, live: bool = False, passed_on: tuple[str, ...] = ()) -> list[str]:
    """What the run verb is called with for a cell, so that anyone can run it by hand."""
    arm = next(a for a in matrix.arms if a.id == cell["arm"])
    args = ["--golden", str(golden_path(cell["golden"], corpora, out)), "--adapter", cell["adapter"], "--docs", str(Path(docs) / cell["doc_class"]), "--out", str(Path(out) / cell_name(cell)), "--repeat", str(cell["repeats"])]
    if cell["adapter"] == matrix.capped_adapter and matrix.cap_branch != "unresolved":
        args += ["--mistral-cap-branch", matrix.cap_branch]
    args += arm.extra
    if live:
        args += ["--live", "--expected-spend-usd", f"{cell['expected_usd']:.4f}", "--pricing-basis", str(arm.pricing_basis), "--pricing-as-of", str(arm.pricing_as_of), "--cal-test-manifest", f"{cell['doc_class']}={dict(matrix.manifests)[cell['doc_class']]}"]
    return [*args, *passed_on]


def cell_name(cell: dict) -> str:
    return f"{cell['arm']}/{cell['doc_class']}/{cell['pass']}"


def chosen(plan: list[dict], names: list[str] | None) -> list[dict]:
    """The cells named ``arm/class/pass``, all without names; an error if a name is no cell's."""
    if not names:
        return plan
    if unknown := set(names) - {cell_name(c) for c in plan}:
        raise ValueError(f"matrix: {min(unknown)} is no cell of the plan")
    return [c for c in plan if cell_name(c) in names]


def derive_capped(spark: SparkSession, golden: str | Path, excluded: list[str], to: str | Path) -> None:
    """The lines of a golden set as they are, without those of excluded documents."""
    out = spark.createDataFrame([(d,) for d in excluded], "doc string")
    lines = spark.read.text(str(golden)).filter(F.trim("value") != "").withColumn("doc", F.get_json_object("value", "$.doc"))
    lines.join(F.broadcast(out), "doc", "left_anti").select("value").write.mode("overwrite").text(str(to))


def capped_goldens(goldens: DataFrame, excluded: DataFrame) -> DataFrame:
    return goldens.join(excluded.select("doc_class", "doc").distinct(), ["doc_class", "doc"], "left_anti")


#: Metrics that are averaged over repeats.
METRICS = ("f1", "precision", "recall", "ece", "brier", "auroc")


def mean_over_repeats(scores: DataFrame, by: tuple[str, ...] = ("arm", "doc_class", "pass", "column")) -> DataFrame:
    """Means of per-repeat corpus metrics; not a pooled metric."""
    return scores.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS if m in scores.columns], F.count(F.lit(1)).alias("repeats"))


def execute(plan: list[dict], run_cell: Callable[[dict], int], score: Callable[[dict, int, str], dict], out: str | Path, meta: Callable[[dict], dict | None] = lambda cell: None, about: dict | None = None) -> dict:
    """Run and score planned cells (rows of ``cells``) one after the other; the matrix manifest.

    ``run_cell`` gives an exit code; a cell that fails is recorded and the next goes on.  ``score(cell, repeat, kind)`` gives a scores
    file's content.  Each cell gets a summary with every repeat's corpus metrics and the means of the primary ones; the manifest
    lists outcomes and what keeps the whole from being published: incomplete cells, gaps in their metadata (``meta``), more than one commit.
    ``about`` joins the manifest.
    """
    from ..sources.sinks import write_json

    outcomes, problems, commits, costs = [], [], set(), []
    for cell in plan:
        name = cell_name(cell)
        code, status, repeats = run_cell(cell), "completed", []
        if code:
            status = "failed_or_paused"
        else:
            for repeat in range(1, cell["repeats"] + 1):
                for kind in cell["scorings"]:
                    try:
                        found = score(cell, repeat, kind)
                    except (ValueError, OSError):
                        status = "scoring_failed"
                        continue
                    repeats.append({"repeat": repeat, "kind": kind, "corpus": found["corpus"], "normalizedCorpus": (found.get("normalized") or {}).get("corpus")})
            primary = [r for r in repeats if r["kind"] == PRIMARY]
            mean = lambda of: {m: sum(r[of][m] for r in primary) / len(primary) for m in METRICS} if primary and all(r[of] for r in primary) else {}  # noqa: B023, E731
            (Path(out) / name).mkdir(parents=True, exist_ok=True)
            write_json(Path(out) / name / "scores.json", {
                "formatVersion": 1, "cell": {k: cell[k] for k in ("arm", "adapter", "doc_class", "pass", "repeats")}, "excludedDocs": cell.get("excluded") or [], "repeats": repeats,
                "meanOverRepeats": mean("corpus"), "meanOverRepeatsNormalized": mean("normalizedCorpus"),
            })
        known = meta(cell)
        outcomes.append({"cell": name, "status": status, "runExit": code})
        problems += [f"{name}: {status}"] if status != "completed" else []
        problems += [f"{name}: no run manifest"] if known is None else [f"{name}: {g}" for g in known.get("missing", [])]
        commits |= {known["commit"]} if known and known.get("commit") else set()
        costs.append({"cell": name, "status": status, "expectedUsd": cell.get("expected_usd"), **{k: (known or {}).get(k) for k in ("spend", "startedAt", "requestIds", "fingerprint", "availability")}})
    problems += ["more than one commit"] if len(commits) > 1 else []
    manifest = {"formatVersion": 1, "generatedAt": datetime.now(UTC).isoformat(), **(about or {}), "cells": outcomes, "validation": {"publicationReady": not problems, "problems": problems}}
    Path(out).mkdir(parents=True, exist_ok=True)
    write_json(Path(out) / "matrix-manifest.json", manifest)
    write_json(Path(out) / "cost-log.json", costs)
    return manifest
