import numpy as np
import pytest

from sparkgauge.functions.rng import STEP, Rng, quantile
from sparkgauge.operators import bootstrap, simulate
from sparkgauge.plans import queries, views


def test_noise_floor_is_the_published_one(spark):
    r = simulate.noise_floor(spark, [196], 20260712, sims=300).first()
    assert r["mean"] == pytest.approx(0.084, abs=0.003)
    assert (r.p05, r.p95) == (pytest.approx(0.058, abs=0.005), pytest.approx(0.114, abs=0.006))


def test_more_documents_detect_smaller_effects(spark):
    mde = lambda n: simulate.detectable_effect(spark, [5] * n, 0.75, [0.06, 0.1, 0.16, 0.24], 20260712, sims=150)["mde"]
    assert mde(12) > mde(48)
    with pytest.raises(ValueError):
        simulate.detectable_effect(spark, [5], 0.75, [0.1], 1)


def test_bands_hold_calibrated_points(spark):
    rows = [(i, (i % 50) / 50 + 0.01, (i * 7919 % 100) / 100 < (i % 50) / 50 + 0.01) for i in range(3000)]
    p = spark.createDataFrame(rows, "ord int, confidence double, correct boolean")
    bands = simulate.consistency_bands(p, ["ord"], 1, sims=60).collect()
    assert len(bands) == 15
    assert all(b.lo <= b.mean_confidence <= b.hi for b in bands)


def test_bands_take_all_points(spark, tmp_path):
    rows = [(i, 1, i % 11 / 100, "NR"[i % 3 == 0], "O") for i in range(1, 76)]
    names = "l_orderkey long, l_linenumber int, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.bin: r for r in queries.q_consistency_bands(spark, str(tmp_path)).collect()}
    points = sorted((d * 10, i, f == "N") for i, _, d, f, _ in rows)
    n, draws = len(points), Rng(bootstrap.SEED)
    of = [((r + 1) * 15 - 1) // n for r in range(n)]
    simulated = {b: [] for b in of}
    for _ in range(1000):
        hits = dict.fromkeys(simulated, 0)
        for b, (c, _, _) in zip(of, points, strict=True):
            hits[b] += draws.next() < c
        for b, k in hits.items():
            simulated[b].append(k / of.count(b))
    assert set(got) == set(of)
    for b, r in got.items():
        mine = [p for at, p in zip(of, points, strict=True) if at == b]
        assert r.bin_n == len(mine)
        assert r.accuracy == pytest.approx(sum(y for _, _, y in mine) / len(mine), abs=1e-6)
        assert (r.lo, r.hi) == pytest.approx((quantile(simulated[b], 0.025), quantile(simulated[b], 0.975)), abs=1e-6)


def test_queries_simulate_as_often_as_the_operators(spark):
    data = "/root/testdata/sf0.001"
    found = {r.n: r.p95 for r in queries.q_noise_floor(spark, data).collect()}
    wanted = {r.n: r.p95 for r in simulate.noise_floor(spark, list(found), bootstrap.SEED, sims=1000).collect()}
    assert found == pytest.approx(wanted)
    per = views.goldens(spark, data).filter("doc_class = 'view'").groupBy("doc").count().orderBy("doc").collect()
    wanted = simulate.detectable_effect(spark, [r["count"] for r in per], 0.75, [0.05, 0.1, 0.2], bootstrap.SEED, sims=600)["grid"]
    assert [tuple(r) for r in queries.q_detectable_effect(spark, data).collect()] == wanted
    ci = queries.q_pooled_interval(spark, "/root/testdata/sf0.001").first()
    assert ci.p_zero < 2 / 501


def test_effect_of_a_table_is_that_of_the_loop(spark, monkeypatch):
    """Blocks that cut the documents anywhere, in a table's order, draw what one loop over them draws."""
    fields = [5, 1, 7, 3, 3, 4] * 5
    loop = lambda delta, seed: [abs(simulate._paired_t(rng, fields, 0.75, delta, 0.6, 0.7)) for rng in [Rng(seed)] for _ in range(60)]
    none = loop(0.0, 7 ^ 0x9E3779B9)
    wanted = [(d, sum(t > quantile(none, 0.95) for t in loop(d, 7 + round(d * 1e6))) / 60) for d in (0.1, 0.2)]
    monkeypatch.setattr(simulate, "DOCUMENTS", 7)
    table = spark.createDataFrame([(f"{i:02}", m) for i, m in enumerate(fields)], "doc string, fields long").repartition(3)
    assert simulate.detectable_effect(spark, table, 0.75, [0.1, 0.2], 7, sims=60, order=["doc"])["grid"] == wanted


@pytest.mark.parametrize("zero", [None, 0, 1, 6, 7])
def test_normals_skip_a_draw_of_zero_like_the_stream(zero):
    seed = 7 if zero is None else -(zero + 1) * STEP % 2**32
    rng = Rng(seed)
    wanted = [rng.normal() for _ in range(40)]
    for first in (0, 1, 6, 9):
        assert simulate._normal(seed, first, 20).tolist() == pytest.approx(wanted[first : first + 20], abs=1e-12)


@pytest.mark.parametrize(("a", "b", "warm"), [(5, 1.5, 1500), (5, 1.5, 3), (0.7, 0.4, 3)])
def test_noise_floor_is_that_of_the_loop(spark, monkeypatch, a, b, warm):
    """Also where blocks begin too late to fall in with the stream, and are made again."""
    monkeypatch.setattr(simulate, "POINTS", 64)
    monkeypatch.setattr(simulate, "WARM", warm)
    monkeypatch.setattr(simulate, "HELD", 500)
    wanted = {}
    for n in (33, 80):
        rng, found = Rng(bootstrap.SEED), []
        for _ in range(40):
            points = [(c, rng.next() < c) for c in (rng.beta(a, b) for _ in range(n))]
            found.append(simulate.plugin_ece(*(np.array(x) for x in zip(*points, strict=True))))
        wanted[n] = (sum(found) / 40, quantile(found, 0.05), quantile(found, 0.95))
    got = {r.n: (r["mean"], r.p05, r.p95) for r in simulate.noise_floor(spark, [80, 33], bootstrap.SEED, sims=40, a=a, b=b).collect()}
    assert set(got) == set(wanted)
    for n in got:
        assert got[n] == pytest.approx(wanted[n], abs=1e-12)
