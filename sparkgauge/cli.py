"""Command line: run, matrix, score, fabrication, report, ci, calibrate, curves, probes, probes-verify,
probes-strike, corpora, dataset, dataset-check.

Exit codes: 0 done, 1 a gate or check failed, 2 wrong usage or input, 3 no number can be given.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import adapters, corpora, dataset, judge, pdf, probes, requests
from .plans import arms, corpus, matrix, report, score
from .plans import run as runs
from .sources import digest, discovery, http, jsonl, sinks
from .sources.checkpoint import LeaseError
from .sources.jsonl import InputError
from .sources.sinks import write_json
from .sources.store import Store, resolve


def number(text: str) -> float:
    """A plain decimal: digits, with a sign and a fraction if need be; no exponent, no other spelling."""
    if not re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", text.strip()):
        raise ValueError(text)
    return float(text)


def session() -> SparkSession:
    return SparkSession.builder.appName("sparkgauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkgauge")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, **flags) -> argparse.ArgumentParser:
        v = sub.add_parser(name)
        for flag, kw in flags.items():
            v.add_argument("--" + flag.replace("_", "-"), **kw)
        return v

    need = {"required": True}
    many = {"required": True, "action": "append"}
    verb("score", predictions=many, golden=many, out=need, normalizers={})
    some = {"action": "append"}
    verb("fabrication", predictions=some, golden=some, arm_dir={}, corpora={}, run_pass={"default": "main", "choices": ["main", "probe"]}, strikes={}, seed={"type": int, "default": 20260712}, resamples={"type": int, "default": 10_000}, out=need)
    verb("report", scores={}, matrix={}, corpora={}, baseline={}, out=need, seed={"type": int, "default": 20260712}, resamples={"type": int, "default": 10_000})
    verb("ci", scores=need, min_f1={"type": number} | need, max_ece={"type": number} | need, baseline={}, eps_f1={"type": number, "default": 0.005}, eps_ece={"type": number, "default": 0.005})
    verb("calibrate", scores=need, max_error={"type": number, "default": 0.05})
    verb("curves", manifest=need)
    flag = {"action": "store_true"}
    passed_on = {"confirm_spend": flag, "resume_paused": flag, "recover_stale_lock": flag, "allow_commit_drift": flag}
    verb("matrix", config=need, corpora={}, pdfs={}, documents={}, goldens={}, fixtures={}, out={}, live=flag, cell=some, plan_only=flag, **passed_on)
    verb("dataset-check", a=need, b=need)
    spend = {"expected_spend_usd": {}, "pricing_basis": {}, "pricing_as_of": {}}
    verb("run", golden=need, adapter=need, docs={}, fixtures={}, out=need, repeat={"type": int, "default": 1}, limit={"type": int}, live=flag, resume_open=flag, mistral_cap_branch={"choices": matrix.CAP_BRANCHES}, cal_test_manifest=some, commit_sha={}, url={}, key_env={}, auth={"choices": ["bearer", "x-goog-api-key"], "default": "bearer"}, model={}, instruction={}, schema={}, **spend, **passed_on)
    verb("probes", schemas=need, golden=some, seed={"type": int, "default": 20260712}, out=need)
    verb("probes-verify", probes=need, texts=need, out=need)
    verb("probes-strike", probes=need, worksheet=need, out=need)
    verb("corpora", source={}, cal_test={}, manifests={}, **{"class": some}, golden={}, pages={}, out=need)
    verb("dataset", golden=many, predictions=many, strikes={}, arm=need, run_pass={"default": "main", "choices": ["main", "probe"]}, denylist={}, probes={}, own_domain={}, out=need)
    return p


def recorded_answers(spark: SparkSession, folder: str | Path):
    """Answers from a folder of recorded ones, a file each."""
    recorded = {r.name: r.response for r in adapters.fixtures(spark, str(folder)).collect()}

    def answer(unit: dict) -> dict:
        if unit["doc"] not in recorded:
            raise ValueError(f"no recorded answer for {unit['doc']}")
        return json.loads(recorded[unit["doc"]])

    return answer


def check_split(spark: SparkSession, golden: str, manifests: list[str] | None, live: bool) -> None:
    """Split manifests (``class=path``) must name their class; a live run needs one for each class of its golden set."""
    named = {}
    for item in manifests or []:
        c, _, path = item.partition("=")
        if not c or not path:
            raise score.UsageError("--cal-test-manifest takes <class>=<path>")
        said = json.loads(Path(path).read_text())
        if not isinstance(said, dict) or said.get("class") != c or not isinstance(said.get("calTestGoldenHash"), str):
            raise score.UsageError(f"{path}: no split manifest of {c}")
        named[c] = said
    if live or named:
        classes = {r.doc_class for r in jsonl.golden_rows(spark, golden).select("doc_class").distinct().collect()}
        if unknown := set(named) - classes:
            raise score.UsageError(f"--cal-test-manifest: {min(unknown)} is no class of the golden set")
        if live and (missing := classes - set(named)):
            raise score.UsageError(f"--cal-test-manifest is missing for {min(missing)}")


def read_selection(path: str) -> dict[str, list[tuple[str, str]]]:
    said = json.loads(Path(path).read_text())
    if said.get("formatVersion") != 1:
        raise score.UsageError(f"{path}: format version 1 is needed")
    return {c: [(p["field"], p["sourceClass"]) for p in v] for c, v in said["probes"].items()}


def probe_table(spark: SparkSession, drawn: dict[str, list[tuple[str, str]]]):
    return spark.createDataFrame([(c, f, s) for c, v in drawn.items() for f, s in v], "doc_class string, field string, source_class string")


def read_exclusions(folder: Path, classes: list[str]) -> tuple[tuple[str, str], ...]:
    """Documents beyond the cap, as the corpus build counted them."""
    path = folder / corpus.COUNTS
    said = json.loads(path.read_text()) if path.is_file() else None
    if not isinstance(said, dict) or "classes" not in said:
        raise score.UsageError(f"{path}: counts of a corpus build are needed for a confirmed cap")
    return tuple((c, x["doc"]) for c, own in said["classes"].items() if c in classes for x in own.get("conditionalExclusions") or [])


def matrix_plan(spark: SparkSession, args: argparse.Namespace) -> tuple[matrix.Matrix, list[dict], Path | None]:
    """The matrix of a config file, its cells in order, and the corpus folder; all that may be wrong with the inputs is found here."""
    said, folder = json.loads(Path(args.config).read_text()), None
    excluded, rules = (), {}
    known = tuple(adapters.REGISTRY)
    if args.corpora:
        folder = resolve(args.corpora)
        m = matrix.read_config(said, known)
        if m.cap_branch == "cap-confirmed":
            excluded = read_exclusions(folder, list(m.classes))
    elif args.goldens:
        folder = Path(args.goldens)
    m = matrix.read_config(said, known, excluded)
    if args.corpora:
        parts = []
        for c in m.classes:
            for p in m.passes:
                path = matrix.golden_path(f"golden.{c}{'.probe' if p == 'probe' else ''}.jsonl", folder, args.out or ".")
                if not path.exists():
                    raise score.UsageError(f"{path}: no golden set for {c}" + (": draw probes first" if p == "probe" else ""))
                parts.append(jsonl.golden_rows(spark, str(path)).select(F.lit(c).alias("doc_class"), F.lit(p).alias("pass"), "doc"))
            rules[c] = folder / f"normalizers.{c}.json"
            if not rules[c].is_file():
                raise score.UsageError(f"{rules[c]}: no normaliser table for {c}")
            if jsonl.read_rules(spark, str(rules[c])).filter(F.col("doc_class") != c).first():
                raise score.UsageError(f"{rules[c]}: a table of another class")
        documents = parts[0]
        for part in parts[1:]:
            documents = documents.unionByName(part)
    elif args.documents:
        documents = spark.read.schema("doc_class string, pass string, doc string").json(args.documents)
    else:
        raise score.UsageError("--corpora is needed, or --documents")
    plan = [r.asDict() for r in matrix.cells(spark, m, documents, args.live).collect()]  # tens of cells
    return m, matrix.chosen(plan, args.cell), folder


def execute_matrix(spark: SparkSession, m: matrix.Matrix, plan: list[dict], folder: Path, fixtures: Path, out: Path, args: argparse.Namespace, passed_on: tuple[str, ...]) -> dict:
    """Planned cells against recorded answers (``fixtures/<arm>``): capped golden sets, runs, scores by repeat, summaries, manifest, cost log."""
    place = lambda cell: out / matrix.cell_name(cell)
    for name in sorted({g for c in plan for g in c["scoring_goldens"] if g.endswith(".capped.jsonl")}):
        c = next(x for x in plan if name in x["scoring_goldens"])
        matrix.derive_capped(spark, matrix.golden_path(name.replace(".capped.jsonl", ".jsonl"), folder, out), c["excluded"], out / "derived" / name)

    def run_cell(cell: dict) -> int:
        line = matrix.run_args(cell, m, folder, args.pdfs or folder / "pdfs", out, args.live, (*passed_on, "--fixtures", str(fixtures / cell["arm"])))
        try:
            return run(parser().parse_args(["run", *line]), spark)
        except SystemExit as e:
            return int(e.code or 2)
        except (ValueError, OSError, RuntimeError) as e:
            print(f"matrix: {matrix.cell_name(cell)}: {e}", file=sys.stderr)
            return 2

    def score_cell(cell: dict, repeat: int, kind: str) -> dict:
        rules = folder / f"normalizers.{cell['doc_class']}.json"
        golden = matrix.golden_path(cell["scoring_goldens"][cell["scorings"].index(kind)], folder, out)
        # answers to documents that a capped golden set lacks meet nothing
        found = score.score(spark, str(golden), str(place(cell) / f"predictions.repeat-{repeat:03}.jsonl"), str(rules) if rules.is_file() else None)
        write_json(place(cell) / f"scores.{kind}.repeat-{repeat:03}.json", found)
        return found

    def about(cell: dict) -> dict | None:
        read = lambda name: json.loads((place(cell) / name).read_text()) if (place(cell) / name).is_file() else None
        m, meta, health = read("run-manifest.json"), read("run-meta.json") or {}, read("run-health.json") or {}
        if m is None:
            return None
        return {
            "commit": m["code"]["commit"], "missing": m["missingFields"], "spend": meta.get("spendPreflight"), "startedAt": meta.get("startedAt"), "fingerprint": m.get("fingerprint"),
            "availability": health.get("aggregate"), "requestIds": m.get("requestIds"),
        }

    said = {"live": args.live, "config": json.loads(Path(args.config).read_text()), "conditionalExclusions": [{"docClass": c, "doc": d} for c, d in m.excluded]}
    return matrix.execute(plan, run_cell, score_cell, out, about, said)


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(args, session())
    except score.NoNumber as e:
        print(f"{args.verb}: {e}", file=sys.stderr)
        return 3
    except (InputError, score.UsageError, OSError, ValueError, LeaseError, requests.Fatal) as e:
        print(f"{args.verb}: {e}", file=sys.stderr)
        return 2


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.verb == "score":
        write_json(args.out, score.score(spark, args.golden, args.predictions, args.normalizers))
    elif args.verb == "fabrication":
        golden = args.golden or (discovery.golden_files(args.corpora, args.run_pass) if args.corpora else None)
        predictions = args.predictions or (discovery.prediction_files(args.arm_dir, args.run_pass) if args.arm_dir else None)
        if not golden or not predictions:
            raise score.UsageError("--golden or --corpora, and --predictions or --arm-dir, are needed")
        write_json(args.out, score.fabrication(spark, golden, predictions, args.strikes, args.seed, args.resamples))
    elif args.verb == "report" and args.matrix:
        if not args.corpora or args.scores:
            raise score.UsageError("--matrix needs --corpora, and no --scores")
        tables = arms.build(spark, args.matrix, args.corpora, args.baseline, args.seed, args.resamples)
        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        for name, text in tables.items():
            (out / name).write_text(text)
    elif args.verb == "report":
        if not args.scores:
            raise score.UsageError("--scores is needed, or --matrix and --corpora")
        now = json.loads(Path(args.scores).read_text())
        old = json.loads(Path(args.baseline).read_text()) if args.baseline else None
        if now.get("version") != 1 or not isinstance(now.get("corpus"), dict):
            raise score.UsageError("scores: version 1 with a corpus is needed")
        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        (out / "report.txt").write_text(report.metric_table(now, old))
        (out / "risk-coverage.svg").write_text(report.risk_coverage_svg(now.get("riskCoverage", [])))
        (out / "reliability.svg").write_text(report.reliability_svg(*score.reliability(spark, args.scores)))
    elif args.verb == "ci":
        if args.baseline is not None and not args.baseline.strip():
            raise score.UsageError("the baseline's path is empty")
        found = score.gate(spark, args.scores, args.min_f1, args.max_ece, args.baseline, args.eps_f1, args.eps_ece)
        print(json.dumps(found))
        return 0 if found["passed"] else 1
    elif args.verb == "calibrate":
        print(json.dumps(score.calibration(spark, args.scores, args.max_error), indent=2))
    elif args.verb == "curves":
        m = json.loads(Path(args.manifest).read_text())
        base = Path(args.manifest).parent
        full = m.get("full", "full")
        if "full" not in m and "logprobFree" not in m.get("variants", {}):
            raise score.UsageError("manifest: variants need full and logprobFree")
        print(json.dumps(score.curves(spark, {k: str(base / v) for k, v in m["variants"].items()}, full), indent=2))
    elif args.verb == "matrix":
        m, plan, folder = matrix_plan(spark, args)
        given = {"--confirm-spend": args.confirm_spend, "--resume-paused": args.resume_paused, "--recover-stale-lock": args.recover_stale_lock, "--allow-commit-drift": args.allow_commit_drift}
        passed_on = tuple(flag for flag, on in given.items() if on)
        if args.out is None:
            for cell in plan:
                print(json.dumps(cell))
        elif args.plan_only:
            for cell in plan:
                print(f"{matrix.cell_name(cell)}: run {' '.join(matrix.run_args(cell, m, folder or '.', args.pdfs or (folder or Path()) / 'pdfs', args.out, args.live, passed_on))}")
        else:
            if folder is None or args.fixtures is None:
                raise score.UsageError("--out needs --corpora or --goldens, and --fixtures")
            done = execute_matrix(spark, m, plan, folder, Path(args.fixtures), Path(args.out), args, passed_on)
            print(json.dumps(done))
            return 0 if all(c["status"] == "completed" for c in done["cells"]) else 1
    elif args.verb == "run":
        if args.fixtures is None and not args.live:
            raise score.UsageError("--fixtures is needed, or --live")
        if args.fixtures is None and not (args.docs and args.url and args.key_env and args.schema):
            raise score.UsageError("--live needs --docs, --url, --key-env and --schema, or recorded answers by --fixtures")
        if args.mistral_cap_branch is not None and args.adapter != matrix.Matrix.capped_adapter:
            raise score.UsageError(f"--mistral-cap-branch is for the adapter {matrix.Matrix.capped_adapter}")
        usd, basis, as_of = runs.check_pricing(args.expected_spend_usd, args.pricing_basis, args.pricing_as_of) if args.live else (None, None, None)
        config = runs.RunConfig(
            args.golden, args.adapter, args.out, args.repeat, limit=args.limit, live=args.live, spend_confirmed=args.confirm_spend, resume_open=args.resume_open or args.resume_paused, expected_usd=usd,
            pricing_basis=basis, pricing_as_of=as_of, recover_lease=args.recover_stale_lock, allow_drift=args.allow_commit_drift,
        )
        check_split(spark, args.golden, args.cal_test_manifest, args.live)
        if args.fixtures is not None:
            health = runs.run(spark, config, recorded_answers(spark, args.fixtures), args.commit_sha)
        else:
            service = http.Service(args.url, args.key_env, args.auth)
            service.key()
            instruction = Path(args.instruction).read_text() if args.instruction else ""
            files = jsonl.read_documents(spark, args.docs).join(jsonl.golden_rows(spark, args.golden).select("doc_class", "doc"), "doc")
            made = requests.bodies(files, args.adapter, Path(args.schema).read_text(), args.model or "", instruction)
            calls = http.jobs(service) if args.adapter == "job" else http.answers(service)
            health = runs.run(spark, config, calls, args.commit_sha, made, adapters.get_adapter(args.adapter))
        print(json.dumps(health))
        return 0 if health["status"] == "complete" else 1
    elif args.verb == "probes":
        schemas = {p.name.removesuffix(".schema.json"): json.loads(p.read_text()) for p in sorted(Path(args.schemas).glob("*.schema.json"))}
        drawn = probes.draw(probes.pools(probes.leaf_fields(spark, schemas)), args.seed)
        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        (out / "probes.json").write_text(probes.selection_json(drawn, args.seed) + "\n")
        for c, found in drawn.items():
            (out / f"{c}.probe.schema.json").write_text(corpora.format_schema(probes.probe_schema(schemas[c], found)) + "\n")
        if args.golden:
            goldens = probes.probe_goldens(jsonl.read_goldens(spark, args.golden), probe_table(spark, drawn))
            for c in drawn:
                lines = goldens.filter(F.col("doc_class") == c).groupBy("doc", "doc_class").agg(F.sort_array(F.collect_list("field")).alias("f")).orderBy("doc").toLocalIterator()
                text = "".join(json.dumps({"doc": r.doc, "docClass": c, "fields": {f: {"state": "missing"} for f in r.f}}) + "\n" for r in lines)
                (out / f"golden.{c}.probe.jsonl").write_text(text)
            (out / "WORKSHEET.md").write_text("\n".join(probes.worksheet(goldens)) + "\n")
    elif args.verb == "probes-verify":
        named = probe_table(spark, read_selection(args.probes))
        hits = probes.text_hits(spark.read.schema("doc_class string, doc string, text string").json(args.texts), named)
        found = [r.asDict() for r in hits.orderBy("doc_class", "doc", "field").collect()]  # a few: probes are absent by design
        write_json(args.out, {"formatVersion": 1, "hits": found})
        return 1 if found else 0
    elif args.verb == "probes-strike":
        selection = read_selection(args.probes)
        struck = probes.strikes(jsonl.read_worksheet(spark, args.worksheet))
        left = {(r.doc_class, r.field) for r in probes.struck_probes(probe_table(spark, selection), struck).collect()}
        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        (out / "probes.json").write_text(probes.selection_json({c: [x for x in v if (c, x[0]) in left] for c, v in selection.items()}, json.loads(Path(args.probes).read_text())["seed"]) + "\n")
        write_json(out / "strikes.json", {"formatVersion": 1, "struck": [{"docClass": r.doc_class, "field": r.field, "documents": r.documents} for r in probes.in_order(struck, "place").orderBy("place").collect()]})
    elif args.verb == "corpora" and (args.source or args.cal_test or args.manifests):
        if not (args.source and args.cal_test and args.manifests):
            raise score.UsageError("--source, --cal-test and --manifests go together")
        told = spark.read.schema("doc_class string, doc string, pages int").json(args.pages) if args.pages else None
        places = corpus.Places(*(p.rstrip("/") for p in (args.source, args.cal_test, args.manifests)))
        said = corpus.build(spark, places, args.out, (lambda _: told) if told is not None else pdf.count_pages, getattr(args, "class"))
        counts = json.loads(Store(spark, args.out).read(f"{said['version']}/{corpus.COUNTS}"))
        print("\n".join([*corpus.summary(counts), f"published {said['version']} in {args.out}"]))
    elif args.verb == "corpora":
        if not args.golden or not args.pages:
            raise score.UsageError("--source, --cal-test and --manifests are needed, or --golden and --pages for schemas and counts alone")
        goldens = jsonl.read_goldens(spark, args.golden)
        counts = corpora.corpus_counts(goldens, spark.read.json(args.pages)).collect()  # a row a class
        schemas = {c: corpora.nullable_schema(goldens.filter(F.col("doc_class") == c).select(F.col("field").alias("pointer"))) for c in sorted(r.doc_class for r in counts if r.doc_class)}
        out = Path(args.out)
        out.mkdir(parents=True, exist_ok=True)
        for c, schema in schemas.items():
            (out / f"{c}.schema.json").write_text(corpora.format_schema(schema) + "\n")
        write_json(out / "corpus-counts.json", [r.asDict() for r in counts])
    elif args.verb == "dataset":
        goldens, records = jsonl.read_goldens(spark, args.golden), jsonl.read_records(spark, args.predictions)
        none = spark.createDataFrame([], "doc_class string, doc string, field string, reason string")
        struck = jsonl.read_strikes(spark, args.strikes) if args.strikes else none
        rows = dataset.prediction_rows(judge.cell_records(goldens, records), struck, args.arm, args.run_pass)
        extra = sinks.denylist(Path(args.denylist).read_text()) if args.denylist else None
        try:
            tables, order = {"predictions": rows, "audit": dataset.audit_rows(goldens, struck)}, {"predictions": ["doc_class", "doc", "repeat", "field"], "audit": ["doc_class", "doc", "field"], "probes": ["doc_class", "field"]}
            if args.probes:
                tables["probes"] = dataset.probe_rows(probe_table(spark, read_selection(args.probes)), struck)
            sinks.write_dataset(tables, args.out, order, sinks.sweeps(args.own_domain, extra))
        except ValueError as e:
            print(f"dataset: {e}", file=sys.stderr)
            return 1
    else:
        at = digest.difference(spark, args.a, args.b)
        if at is not None:
            print(f"dataset-check: lines {at.first + 1} to {at.end} differ ({at.lines[0]} and {at.lines[1]} lines there)", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
