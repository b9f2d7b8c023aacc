import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.functions.rng import Rng, uniforms
from sparkgauge.operators import bootstrap

CELLS = "doc_class string, doc long, tp long, fp long, fn long"


def cells(n=40, seed=5):
    r = random.Random(seed)
    return [(r.choice("abc"), i, r.randint(0, 6), r.randint(0, 3), r.randint(0, 4)) for i in range(n)]


def f1(rows):
    tp, fp, fn = (sum(r[k] for r in rows) for k in (2, 3, 4))
    p, c = tp / (tp + fp) if tp + fp else 1.0, tp / (tp + fn) if tp + fn else 1.0
    return 2 * p * c / (p + c) if p + c else 0.0


def same(a, b):
    assert (a.method, a.resamples, a.level) == (b.method, b.resamples, b.level)
    assert (a.estimate, a.lo, a.hi, a.p_zero) == pytest.approx((b.estimate, b.lo, b.hi, b.p_zero), abs=1e-9)


def test_draws_are_the_stream():
    rng = Rng(77)
    wanted = [rng.next() for _ in range(2000)]
    assert uniforms(77, np.arange(2000)).tolist() == wanted
    assert uniforms(77, np.arange(1500, 2000)).tolist() == wanted[1500:]


@pytest.mark.parametrize("block_bytes", [16 << 20, 24 * 7, 24])
def test_sums_equal_a_loop_whatever_the_blocks(spark, block_bytes):
    data = sorted(cells(), key=lambda r: (r[0], r[1]))
    placed = bootstrap.numbered(spark.createDataFrame(data, CELLS), ["doc_class", "doc"], "doc_class")
    got = bootstrap.resample_vectors(spark, placed, ["tp", "fp", "fn"], 3, 50, block_bytes)
    assert [t for _, t in got.dtypes] == ["bigint"] * 4
    strata, rng = [[r for r in data if r[0] == c] for c in "abc"], Rng(3)
    wanted = []
    for b in range(50):
        drawn = [s[rng.int(len(s))] for s in strata for _ in s]
        wanted.append((b, *(sum(r[k] for r in drawn) for k in (2, 3, 4))))
    assert sorted(map(tuple, got.collect())) == wanted


def test_draws_in_parts(spark, monkeypatch):
    frame = spark.createDataFrame(cells(), CELLS)
    placed = bootstrap.numbered(frame, ["doc_class", "doc"])
    whole = sorted(map(tuple, bootstrap.resample_vectors(spark, placed, ["tp"], 3, 20).collect()))
    u = uniforms(3, np.arange(20 * 40)).reshape(20, 40)
    tp = np.array([r[2] for r in sorted(cells(), key=lambda r: (r[0], r[1]))])
    assert whole == [(b, int(tp[np.floor(x * 40).astype(int)].sum())) for b, x in enumerate(u)]


@pytest.mark.parametrize("stratum", [None, "doc_class"])
def test_f1_interval_equals_the_loop(spark, stratum):
    data = sorted(cells(), key=lambda r: (r[0], r[1]))
    got = bootstrap.interval(spark, spark.createDataFrame(data, CELLS), ["tp", "fp", "fn"], bootstrap.pooled_f1, ["doc_class", "doc"], stratum, 11, 400, 0.9)
    strata = [[r for r in data if r[0] == c] for c in "abc"] if stratum else [data]
    same(got, bootstrap.interval_of(strata, f1, 11, 400, 0.9))


def test_macro_f1_and_several_at_once(spark):
    data = sorted(cells(), key=lambda r: (r[0], r[1]))
    wide, columns = bootstrap.by_class(spark.createDataFrame(data, CELLS), ["a", "b", "c"], ["tp", "fp", "fn"])
    closings = {"macro": bootstrap.macro_f1(3), "pooled": bootstrap.pooled_f1}
    got = bootstrap.resampled(spark, wide, ["tp", "fp", "fn", *columns], closings, ["doc_class", "doc"], "doc_class", 11, 300)
    strata = [[r for r in data if r[0] == c] for c in "abc"]
    same(got["pooled"].interval(), bootstrap.interval_of(strata, f1, 11, 300))
    same(got["macro"].interval(), bootstrap.interval_of(strata, lambda rows: sum(f1([r for r in rows if r[0] == c]) for c in "abc") / 3, 11, 300))


def test_paired_f1_delta(spark):
    a, b = cells(30, 1), cells(30, 2)
    rows = [(0, i, *x[2:], *y[2:]) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    names = ["a_tp", "a_fp", "a_fn", "b_tp", "b_fp", "b_fn"]
    frame = spark.createDataFrame(rows, "doc_class long, doc long, " + ", ".join(f"{n} long" for n in names))
    got = bootstrap.interval(spark, frame, names, bootstrap.f1_delta, ["doc"], None, 4, 300)
    same(got, bootstrap.interval_of([rows], lambda rs: f1([(0, 0, *r[2:5]) for r in rs]) - f1([(0, 0, *r[5:8]) for r in rs]), 4, 300))


def test_edges(spark):
    one = spark.createDataFrame([("a", 1, 2, 1, 0)], CELLS)
    got = bootstrap.interval(spark, one, ["tp", "fp", "fn"], bootstrap.pooled_f1, ["doc"], None, 1, 20)
    assert (got.method, got.lo, got.hi) == ("degenerate", got.estimate, got.estimate)
    assert bootstrap.interval(spark, one.limit(0), ["tp", "fp", "fn"], bootstrap.pooled_f1, ["doc"]) is None
    for bad in ({"resamples": 0}, {"level": 1.0}):
        with pytest.raises(ValueError):
            bootstrap.interval(spark, one, ["tp"], lambda s: s("tp"), ["doc"], None, **bad)


def family():
    r = random.Random(9)
    rows = []
    for d in range(30):
        rows.append(("base", "c", d, float(r.randint(0, 8)) / 8))
        rows.append(("near", "c", d, float(r.randint(0, 8)) / 8))
        rows.append(("far", "c", d, float(r.randint(6, 12)) / 8))
        if d % 3:
            rows.append(("part", "c", d, float(r.randint(3, 9)) / 8))
    return rows


def test_contrasts_equal_loops_and_holm(spark):
    rows = family()
    got = {r.contrast: r for r in bootstrap.contrasts(spark, spark.createDataFrame(rows, "arm string, doc_class string, doc long, value double"), "base", seed=8, resamples=400).collect()}
    of = lambda arm: {d: v for a, _, d, v in rows if a == arm}
    base = of("base")
    wanted = {}
    for arm in ("far", "near", "part"):
        pairs = [(of(arm)[d] - base[d] if d in of(arm) else 0.0, int(d in of(arm))) for d in sorted(base)]
        wanted[arm] = bootstrap.interval_of([pairs], lambda ps: sum(p[0] for p in ps) / sum(p[1] for p in ps), 8, 400)
        mine = got[arm]
        assert (mine.estimate, mine.lo, mine.hi, mine.p) == pytest.approx((wanted[arm].estimate, wanted[arm].lo, wanted[arm].hi, wanted[arm].p_zero), abs=1e-9)
        assert mine.docs == sum(p[1] for p in pairs)
    # a step down by p, then by name
    run, stopped = 0.0, False
    for k, arm in enumerate(sorted(wanted, key=lambda a: (wanted[a].p_zero, a))):
        p, left = wanted[arm].p_zero, 3 - k
        run = max(run, min(1.0, left * p))
        stopped = stopped or p > 0.05 / left
        assert (got[arm].adjusted, got[arm].step_alpha, got[arm].rejected) == (pytest.approx(run), pytest.approx(0.05 / left), not stopped)
        assert got[arm].adjusted_lo <= got[arm].lo
        assert got[arm].hi <= got[arm].adjusted_hi
    assert got["far"].rejected
    # an arm in all documents gets what it gets alone
    alone = bootstrap.contrasts(spark, spark.createDataFrame([r for r in rows if r[0] in ("base", "near")], "arm string, doc_class string, doc long, value double"), "base", seed=8, resamples=400).first()
    assert (alone.lo, alone.hi, alone.p) == (got["near"].lo, got["near"].hi, got["near"].p)


def test_contrasts_refuse(spark):
    rows = spark.createDataFrame(family(), "arm string, doc_class string, doc long, value double")
    with pytest.raises(ValueError, match="baseline"):
        bootstrap.contrasts(spark, rows, "nobody")
    lone = bootstrap.contrasts(spark, rows.filter("arm in ('base', 'near') and (arm = 'base' or doc < 0)"), "base", resamples=10)
    assert lone.count() == 0
    with pytest.raises(ValueError, match="p-value"):
        bootstrap.holm(rows.select(F.lit(1).alias("fam"), F.lit(1.2).alias("p"), F.lit(1).alias("ord")), ["fam"])


def test_constant_deltas_pin_the_interval(spark):
    rows = [(a, "c", d, d / 4 + (0.5 if a == "x" else 0)) for d in range(12) for a in ("base", "x")]
    r = bootstrap.contrasts(spark, spark.createDataFrame(rows, "arm string, doc_class string, doc long, value double"), "base", resamples=1000).first()
    assert (r.method, r.lo, r.hi) == ("degenerate", 0.5, 0.5)
    assert r.p < 0.01
    assert math.isclose(r.acceleration, 0.0)
