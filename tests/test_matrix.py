import json
import os
import subprocess
import sys
import threading

import pytest

from sparkgauge import cli
from sparkgauge.operators.adapters import REGISTRY
from sparkgauge.plans import matrix
from sparkgauge.plans import run as runs
from sparkgauge.sources import checkpoint
from sparkgauge.sources.checkpoint import Lease, LeaseError

CONFIG = {
    "formatVersion": 1, "capBranch": "cap-confirmed", "classes": ["inv"], "repeats": 2, "passes": ["main", "probe"],
    "armModes": [{"id": "a1", "adapter": "stated", "spend": {"usdPerDocRepeat": 0.5, "basis": "list", "asOf": "2026-01-31"}}, {"id": "a4", "adapter": "annotation", "spend": {"usdPerDocRepeat": 0.1, "basis": "list", "asOf": "2026-01-31"}}],
    "calTestManifests": {"inv": "m.json"},
}


def bent(**changes):
    arms = changes.pop("arm", None)
    said = json.loads(json.dumps(CONFIG)) | changes
    if arms is not None:
        said["armModes"][0] |= arms
    return said


@pytest.mark.parametrize("bad", [
    [], bent(formatVersion=2), bent(capBranch="cap-absent"), bent(capBranch=None), bent(classes=[]), bent(classes=["inv", "inv"]), bent(classes=["../x"]), bent(repeats=0), bent(repeats=1.5), bent(repeats=True),
    bent(passes=[]), bent(passes=["main", "refit"]), bent(passes=["cal-fit"]), bent(passes=["calfit-main"]), bent(passes=["else"]), bent(passes=["main", "main"]), bent(armModes=[]), bent(arm={"id": "A1"}), bent(arm={"id": "a4"}),
    bent(arm={"adapter": "none"}), bent(arm={"extraArgs": "x"}), bent(arm={"spend": {"usdPerDocRepeat": 0, "basis": "x", "asOf": "2026-01-31"}}), bent(arm={"spend": {"usdPerDocRepeat": 1, "basis": " ", "asOf": "2026-01-31"}}),
    bent(arm={"spend": {"usdPerDocRepeat": 1, "basis": "x", "asOf": "31.1.2026"}}), bent(calTestManifests={"other": "x"}), bent(calTestManifests={"inv": 3}), *[bent(arm={"extraArgs": [f"{flag}=1"]}) for flag in matrix.RESERVED],
])
def test_configs_that_are_refused(bad):
    with pytest.raises(ValueError, match="matrix"):
        matrix.read_config(bad, tuple(REGISTRY))


def test_a_config_is_read_and_live_runs_need_more():
    m = matrix.read_config(bent(capBranch="cap-removed", arm={"extraArgs": ["--limit", "3"]}), tuple(REGISTRY), (("inv", "x.pdf"),))
    assert (m.cap_branch, m.arms[0].extra, m.arms[1].usd_per_unit, m.arms[1].pricing_basis) == ("cap-removed", ("--limit", "3"), 0.1, "list")
    m.validate(live=True)
    for bad in (bent(capBranch="unresolved"), bent(calTestManifests={}), bent(arm={"spend": None})):
        with pytest.raises(ValueError, match="live|unresolved"):
            matrix.read_config(bad, tuple(REGISTRY)).validate(live=True)


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture
def corpora(tmp_path):
    top = tmp_path / "corpora"
    cell = lambda d: {"state": "present", "value": f"v{d}"}
    lines(top / "golden.inv.jsonl", [{"doc": d, "docClass": "inv", "fields": {"/a": cell(d)}} for d in "pqr"])
    lines(top / "probes/golden.inv.probe.jsonl", [{"doc": d, "docClass": "inv", "fields": {"/z": {"state": "missing"}}} for d in "pqr"])
    (top / "normalizers.inv.json").write_text(json.dumps({"docClass": "inv", "normalizers": {"/a": "text"}}))
    (top / "corpus-counts.json").write_text(json.dumps({"classes": {"inv": {"conditionalExclusions": [{"docClass": "inv", "doc": "r", "pages": 9}]}, "else": {"conditionalExclusions": [{"doc": "p"}]}}}))
    (tmp_path / "m.json").write_text(json.dumps({"class": "inv", "calTestGoldenHash": "0"}))
    for arm in ("a1", "a4"):
        for d in "pqr":
            (tmp_path / "fx" / arm).mkdir(parents=True, exist_ok=True)
            # the document beyond the cap is answered wrongly
            (tmp_path / "fx" / arm / f"{d}.json").write_text(json.dumps({"/a": {"value": "wrong" if d == "r" else f"v{d}", "confidence": 0.9}}))
    return top


def go(tmp_path, corpora, said, *more):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(said))
    return cli.main(["matrix", "--config", str(config), "--corpora", str(corpora), "--fixtures", str(tmp_path / "fx"), "--out", str(tmp_path / "o"), *more])


def test_from_config_to_manifest_with_a_cap(spark, tmp_path, corpora):
    assert go(tmp_path, corpora, bent(passes=["main"])) == 0
    out = tmp_path / "o"
    done = json.loads((out / "matrix-manifest.json").read_text())
    assert [c["cell"] for c in done["cells"]] == ["a1/inv/main", "a4/inv/main"]
    assert done["conditionalExclusions"] == [{"docClass": "inv", "doc": "r"}]
    capped = [x for p in sorted((out / "derived/golden.inv.capped.jsonl").glob("part-*")) for x in p.read_text().splitlines()]
    assert capped == (corpora / "golden.inv.jsonl").read_text().splitlines()[:2]
    own = json.loads((out / "a1/inv/main/scores.json").read_text())
    # primary scores are on the capped set for every arm, the appendix on the whole one
    assert {(r["repeat"], r["kind"]): (r["corpus"]["docs"], round(r["corpus"]["f1"], 4)) for r in own["repeats"]} == {(k, kind): x for k in (1, 2) for kind, x in (("primary", (2, 1.0)), ("appendix", (3, 0.6667)))}
    assert (own["meanOverRepeats"]["f1"], own["meanOverRepeatsNormalized"]["f1"], own["excludedDocs"]) == (1.0, 1.0, ["r"])
    # the capped adapter never runs what is beyond the cap
    four = json.loads((out / "a4/inv/main/scores.json").read_text())
    assert {(r["kind"], r["corpus"]["docs"]) for r in four["repeats"]} == {("primary", 2)}
    ran = {json.loads(x)["doc"] for x in (out / "a4/inv/main/predictions.repeat-001.jsonl").read_text().splitlines()}
    assert ran == {"p", "q"}
    assert json.loads((out / "a4/inv/main/run-health.json").read_text())["planned"] == 4
    costs = {c["cell"]: c for c in json.loads((out / "cost-log.json").read_text())}
    assert (costs["a1/inv/main"]["expectedUsd"], round(costs["a4/inv/main"]["expectedUsd"], 6)) == (3.0, 0.4)
    assert costs["a1/inv/main"]["startedAt"]
    assert costs["a1/inv/main"]["spend"]["plannedUnits"] == 6


def test_plans_cells_and_wrong_inputs(spark, tmp_path, corpora, capsys):
    assert go(tmp_path, corpora, CONFIG, "--plan-only", "--live", "--confirm-spend", "--cell", "a4/inv/main") == 0
    (line,) = capsys.readouterr().out.splitlines()
    out = tmp_path / "o"
    assert line == (
        f"a4/inv/main: run --golden {out}/derived/golden.inv.capped.jsonl --adapter annotation --docs {corpora}/pdfs/inv --out {out}/a4/inv/main --repeat 2 --mistral-cap-branch cap-confirmed "
        "--live --expected-spend-usd 0.4000 --pricing-basis list --pricing-as-of 2026-01-31 --cal-test-manifest inv=m.json --confirm-spend"
    )
    assert not out.exists()
    assert go(tmp_path, corpora, CONFIG, "--cell", "a9/inv/main") == 2
    assert go(tmp_path, corpora, bent(classes=["inv", "none"])) == 2
    (corpora / "corpus-counts.json").rename(corpora / "gone.json")
    assert go(tmp_path, corpora, CONFIG) == 2
    assert go(tmp_path, corpora, bent(capBranch="cap-removed"), "--plan-only") == 0
    (corpora / "normalizers.inv.json").write_text(json.dumps({"docClass": "else", "normalizers": {}}))
    (corpora / "probes/golden.inv.probe.jsonl").unlink()
    assert go(tmp_path, corpora, bent(capBranch="cap-removed")) == 2
    assert not out.exists()


@pytest.mark.parametrize("bad", [["--live"], ["--live", "--expected-spend-usd", "0"], ["--live", "--expected-spend-usd", "3"], ["--live", "--expected-spend-usd", "3", "--pricing-basis", "x", "--pricing-as-of", "2026-02-30"],
                                 ["--live", "--expected-spend-usd", "3", "--pricing-basis", "x", "--pricing-as-of", "2026-02-03"], ["--mistral-cap-branch", "cap-removed"], ["--cal-test-manifest", "inv"], ["--cal-test-manifest", "x=m.json"]])
def test_run_flags_that_are_refused(spark, tmp_path, corpora, bad):
    bad = [x.replace("m.json", str(tmp_path / "m.json")) for x in bad]
    assert cli.main(["run", "--golden", str(corpora / "golden.inv.jsonl"), "--adapter", "stated", "--fixtures", str(tmp_path / "fx/a1"), "--out", str(tmp_path / "x"), *bad]) == 2
    assert not (tmp_path / "x").exists()


def test_a_live_run_states_its_spend_first(spark, tmp_path, corpora):
    flags = ["--live", "--confirm-spend", "--expected-spend-usd", "6", "--pricing-basis", "list", "--pricing-as-of", "2026-02-03", "--cal-test-manifest", f"inv={tmp_path / 'm.json'}", "--commit-sha", "abc"]
    assert cli.main(["run", "--golden", str(corpora / "golden.inv.jsonl"), "--adapter", "stated", "--fixtures", str(tmp_path / "fx/a1"), "--out", str(tmp_path / "x"), "--repeat", "2", *flags]) == 0
    said = json.loads((tmp_path / "x/spend-preflight.json").read_text())
    assert (said["plannedUnits"], said["remainingUnits"], said["expectedUsd"], said["expectedRemainingUsd"], said["pricingAsOf"]) == (6, 6, 6.0, 6.0, "2026-02-03")
    assert runs.preflight(runs.RunConfig("g", "x", "o", 2, usd_per_unit=0.5), 5, 4)["expectedRemainingUsd"] == 3.0


# --- the lease ---------------------------------------------------------------------------


def dead(folder, **changes):
    p = subprocess.run([sys.executable, "-c", "import os; print(os.getpid())"], capture_output=True, text=True, check=True)
    owner = Lease(folder, "f").owner | {"pid": int(p.stdout), "started": "1", "nonce": "old"} | changes
    (folder / ".lease").write_text(json.dumps(owner))
    return owner


def test_a_live_owner_is_left_alone(tmp_path):
    with Lease(tmp_path, "f") as held:
        for recover in (True, False):
            with pytest.raises(LeaseError, match="held by process"):
                Lease(tmp_path, "f", recover).acquire()
        held.check()
    assert not list(tmp_path.glob(".lease*"))


def test_a_dead_owner_is_recovered_if_asked(tmp_path):
    dead(tmp_path)
    with pytest.raises(LeaseError, match="may be recovered"):
        Lease(tmp_path, "f", recover=False).acquire()
    with Lease(tmp_path, "f", recover=True) as held:
        assert json.loads((tmp_path / ".lease").read_text())["nonce"] == held.owner["nonce"]
    assert json.loads((tmp_path / ".lease.stale-old").read_text())["nonce"] == "old"


def test_a_number_that_is_used_again_is_not_the_owner(tmp_path):
    dead(tmp_path, pid=os.getpid(), started="1")
    with Lease(tmp_path):
        pass
    dead(tmp_path, pid=os.getpid(), started=checkpoint._started(os.getpid()))
    with pytest.raises(LeaseError, match="held by process"):
        Lease(tmp_path).acquire()


def test_other_machines_and_unreadable_records_stay(tmp_path):
    dead(tmp_path, host="elsewhere")
    with pytest.raises(LeaseError, match="held on elsewhere"):
        Lease(tmp_path).acquire()
    for text in ("", "{", '{"pid": "x"}', "[]"):
        (tmp_path / ".lease").write_text(text)
        with pytest.raises(LeaseError, match="can't be read"):
            Lease(tmp_path).acquire()


def test_of_many_recoverers_one_wins(tmp_path):
    for _ in range(20):
        dead(tmp_path)
        won, lost, start = [], [], threading.Barrier(8)

        def recover(won=won, lost=lost, start=start):
            lease = Lease(tmp_path, "f")
            start.wait()
            try:
                won.append(lease.acquire())
            except LeaseError as e:
                lost.append(e)

        threads = [threading.Thread(target=recover) for _ in range(8)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert (len(won), len(lost)) == (1, 7) or (len(won), len(lost)) == (0, 8)
        if won:
            won[0].check()
            won[0].release()
        else:
            (tmp_path / ".lease").unlink(missing_ok=True)
        assert not (tmp_path / ".lease.recovery").exists()


def test_a_recoverer_that_comes_second_sees_the_first(tmp_path, monkeypatch):
    found = dead(tmp_path)
    first, second = Lease(tmp_path, "f"), Lease(tmp_path, "f")
    assert first._take_over(found)
    # the second looked before the first was done, and looks again under its guard
    with pytest.raises(LeaseError, match="held by process"):
        second._take_over(found)
    first.check()
    with pytest.raises(LeaseError, match="another run"):
        second.check()


def test_an_owner_that_was_recovered_from_appends_nothing(tmp_path):
    log = tmp_path / "log"
    old = Lease(tmp_path, "f").acquire()
    checkpoint.durable_append(log, {"k": 1}, old)
    os.rename(tmp_path / ".lease", tmp_path / ".lease.stale")
    with Lease(tmp_path, "f") as new:
        with pytest.raises(LeaseError, match="another run"):
            checkpoint.durable_append(log, {"k": 2}, old)
        checkpoint.durable_append(log, {"k": 3}, new)
        old.release()
        new.check()
    assert [json.loads(x)["k"] for x in log.read_text().splitlines()] == [1, 3]
