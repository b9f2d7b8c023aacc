import json

import pytest

from sparkgauge import cli
from sparkgauge.operators import bootstrap
from sparkgauge.plans import arms

ANSWERS = {
    # arm: class: document: what is said of /a in each of two repeats, with confidences
    "base": {"inv": {"p": ("p", "p"), "q": ("q", "x"), "r": ("x", "x")}, "bill": {"s": ("s", "s"), "t": ("x", "t")}},
    "good": {"inv": {"p": ("P ", "p"), "q": ("q", "q"), "r": ("r", "r")}, "bill": {"s": ("s", "s"), "t": ("t", "t")}},
}


@pytest.fixture
def place(tmp_path):
    corpora, out = tmp_path / "corpora", tmp_path / "out"
    corpora.mkdir()
    put = lambda path, rows: (path.parent.mkdir(parents=True, exist_ok=True), path.write_text("".join(json.dumps(r) + "\n" for r in rows)))
    for c, docs in ANSWERS["base"].items():
        put(corpora / f"golden.{c}.jsonl", [{"doc": d, "docClass": c, "fields": {"/a": {"state": "present", "value": d}, "/no": {"state": "missing"}}} for d in docs])
        (corpora / f"normalizers.{c}.json").write_text(json.dumps({"docClass": c, "normalizers": {"/a": "text"}}))
    (corpora / "corpus-counts.json").write_text(json.dumps({"classes": {c: {"pageCounts": [{"doc": d, "pages": 2} for d in docs]} for c, docs in ANSWERS["base"].items()}}))
    for arm, classes in ANSWERS.items():
        for c, docs in classes.items():
            for k in (0, 1):
                extra = {"confidence": 0.9 - 0.3 * k} if arm == "base" else {}
                put(out / arm / c / "main" / f"predictions.repeat-00{k + 1}.jsonl", [{"doc": d, "docClass": c, "repeat": k + 1, "fields": {"/a": {"value": v[k], **extra}}, "provenance": {"calibratorVersion": "cal-2026.05-1"}} for d, v in docs.items()])
    (out / "matrix-manifest.json").write_text(json.dumps({"config": {"classes": ["inv", "bill"], "repeats": 2, "armModes": [{"id": "base"}, {"id": "good"}]}}))
    (out / "cost-log.json").write_text(json.dumps([{"cell": f"{a}/{c}/main", "expectedUsd": 0.2} for a in ANSWERS for c in ANSWERS["base"]]))
    return out, corpora


def f1(tp, fp, fn):
    p, r = tp / (tp + fp) if tp + fp else 1.0, tp / (tp + fn) if tp + fn else 1.0
    return 2 * p * r / (p + r) if p + r else 0.0


def by_hand(arm, normal):
    """(class, document, mean tp, fp, fn) by the answers."""
    same = lambda v, d: (v.strip().lower() if normal else v) == d
    return [(c, d, *(sum(x) / 2 for x in zip(*[(1, 0, 0) if same(v, d) else (0, 1, 1) for v in said], strict=True))) for c, docs in sorted(ANSWERS[arm].items()) for d, said in sorted(docs.items())]


def test_tables_of_a_matrix(spark, place, tmp_path):
    out, corpora = place
    assert cli.main(["report", "--matrix", str(out), "--corpora", str(corpora), "--out", str(tmp_path / "r"), "--resamples", "200"]) == 0
    read = lambda name: (tmp_path / "r" / name).read_text()
    macro = lambda rows: sum(f1(*[sum(r[k] for r in rows if r[0] == c) for k in (2, 3, 4)]) for c in ("bill", "inv")) / 2
    head = read("headline.txt").splitlines()
    for line, arm in zip(head[2:], ("base", "good"), strict=True):
        rows = by_hand(arm, True)
        ci = bootstrap.interval_of([[r for r in rows if r[0] == c] for c in ("bill", "inv")], macro, bootstrap.SEED, 200)
        assert line.startswith(arm)
        assert f"{ci.estimate:.3f} [{ci.lo:.3f}, {ci.hi:.3f}]" in line
        assert "$20.00" in line  # 0.4 dollars for ten pages, twice
    assert "none surfaced" in head[3]
    accuracy = read("accuracy.txt").splitlines()
    # strict: one answer of the better arm has other letters
    strict = [f1(*[sum(r[k] for r in by_hand("good", False) if r[0] == "inv") for k in (2, 3, 4)]), f1(*[sum(r[k] for r in by_hand("good", True) if r[0] == "inv") for k in (2, 3, 4)])]
    assert strict[0] < strict[1] == 1.0
    assert f"{strict[0]:.3f} [" in accuracy[3]
    assert "1.000 [1.000, 1.000]" in accuracy[3]
    assert "base (cal-2026.05-1)" in read("confidence.txt")
    contrast = read("contrasts.txt").splitlines()[2]
    delta = lambda arm: [f1(*r[2:]) for r in by_hand(arm, True)]
    mean = sum(a - b for a, b in zip(delta("good"), delta("base"), strict=True)) / 5
    assert contrast.startswith("good")
    assert f"{mean:+.3f} [" in contrast
    assert read("noise.txt").count("\n") == 4
    assert "bill" in read("effects.txt")


def test_wrong_places(spark, place, tmp_path):
    out, corpora = place
    go = lambda *more: cli.main(["report", "--matrix", str(out), "--out", str(tmp_path / "r"), *more])
    assert go() == 2
    assert go("--corpora", str(corpora), "--baseline", "nobody") == 2
    (out / "good/bill/main/predictions.repeat-001.jsonl").unlink()
    (out / "good/bill/main/predictions.repeat-002.jsonl").unlink()
    with pytest.raises(ValueError, match="no predictions"):
        arms.Place(out, corpora).predictions("good", "bill")
    assert cli.main(["report", "--out", str(tmp_path / "r")]) == 2
