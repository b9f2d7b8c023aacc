import itertools

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import bootstrap, calibrate, cells, judge, metrics

GOLD = "doc_class string, doc string, doc_ord long, field string, field_ord int, state string, value_json string"
PRED = "doc_class string, doc string, field string, value_json string, confidence double"


def test_state_matrix(spark):
    gold = [("present", '"a"'), ("null", None), ("missing", None)]
    pred = ['"a"', '"b"', "null", None]
    g = [("c", f"{i}", i, "/f", 0, s, v) for i, ((s, v), _) in enumerate(itertools.product(gold, pred))]
    p = [("c", f"{i}", "/f", v, None) for i, (_, v) in enumerate(itertools.product(gold, pred)) if v is not None]
    rows = cells.confusion(cells.correctness(cells.join_cells(spark.createDataFrame(g, GOLD), spark.createDataFrame(p, PRED))))
    got = [(r.tp, r.fp, r.fn, r.correct, r.confidence) for r in rows.orderBy("doc_ord").collect()]
    absent = [(0, 1, 0, False, 0.5), (0, 1, 0, False, 0.5), (0, 0, 0, True, 0.5), (0, 0, 0, True, 0.5)]
    assert got == [(1, 0, 0, True, 0.5), (0, 1, 1, False, 0.5), (0, 0, 1, False, 0.5), (0, 0, 1, False, 0.5), *absent, *absent]


def test_two_columns(spark):
    fields = ["/total", "/issued", "/name", "/note"]
    g = spark.createDataFrame([("c", "d", 0, f, i, "present", v) for i, (f, v) in enumerate(zip(fields, ['"1880"', '"2024-01-31"', '"A  b"', '"x"'], strict=True))], GOLD)
    p = spark.createDataFrame([("c", "d", f, v, 0.9) for f, v in zip(fields, ['"$1,880.00"', '"1/31/2024"', '"a B"', '"x"'], strict=True)], PRED)
    rules = spark.createDataFrame([("c", "/total", "currency"), ("c", "/issued", "date"), ("c", "/name", "text")], "doc_class string, pattern string, kind string")
    got = {r.column: (r.tp, r.fp, r.fn) for r in cells.score_table(cells.dual_columns(cells.join_cells(g, p), rules), ["column"]).collect()}
    assert got == {"strict": (1, 3, 3), "normalized": (4, 0, 0)}


def test_empty_denominators(spark):
    p, r, f1 = cells.scores(F.lit(0), F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(p, r, f1).first()) == (1.0, 1.0, 1.0)


POINTS = [(0, 0.9, True), (1, 0.7, False), (2, 0.6, True), (3, 0.3, False)]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(POINTS, "ord int, confidence double, correct boolean")


def test_worked_points(points):
    m = metrics.corpus_metrics(points, [], ["ord"]).first()
    assert m.ece == pytest.approx(0.375)
    assert m.auroc == pytest.approx(0.75)
    curve = [(r.coverage, r.error) for r in metrics.risk_coverage(points, []).orderBy("coverage").collect()]
    assert curve == [(0.0, 0.0), (0.25, 0.0), (0.5, 0.5), (0.75, pytest.approx(1 / 3)), (1.0, 0.5)]


def test_bins_equal_the_loop(spark):
    for n in (1, 7, 15, 16, 44):
        rows = spark.createDataFrame([(i, (i * 7 % n) / n, True) for i in range(n)], "ord int, confidence double, correct boolean")
        got = [r.bin_n for r in metrics.reliability(rows, [], ["ord"]).orderBy("bin").collect()]
        k = min(15, n)
        assert got == [(b + 1) * n // k - b * n // k for b in range(k)]


def test_single_class_and_ties(spark):
    same = spark.createDataFrame([(i, 0.5, True) for i in range(4)], "ord int, confidence double, correct boolean")
    assert metrics.auroc(same, []).first().auroc == 0.5
    assert metrics.risk_coverage(same, []).count() == 2


def test_threshold(points):
    best = metrics.selective_threshold(points, [], 0.4).first()
    assert (best.tau, best.coverage) == (0.6, 0.75)


RECORD = "doc_class string, doc string, repeat int, availability string, fields map<string, struct<value_json: string, confidence: double>>"


def judged(spark, gold, records):
    g = spark.createDataFrame([(*x[:2], 0, x[2], 0, x[3], x[4]) for x in gold], GOLD)
    return judge.cell_records(g, spark.createDataFrame(records, RECORD))


def test_repeat_mean_and_outage(spark):
    gold = [("c", "d", "/a", "missing", None), ("c", "d", "/b", "present", '"x"')]
    done = lambda r, v: ("c", "d", r, "completed", {"/a": (v, 0.8), "/b": ('"y"', None)})
    means = judge.cell_means(judged(spark, gold, [done(1, '"invented"'), done(2, "null")]))
    all_ = judge.rates(means).filter("pooled = 1").first()
    assert (all_.headline_rate, all_.answered_rate) == (0.5, 1.0)
    means = judge.cell_means(judged(spark, gold, [done(1, '"invented"'), ("c", "d", 2, "contract_failure", {})]))
    all_ = judge.rates(means).filter("pooled = 1").first()
    assert (all_.headline_rate, all_.dual_rate, all_.excluded_cells) == (1.0, 0.5, 0)


def test_class_floor(spark):
    gold = [("big", f"{i}", "/a", "missing", None) for i in range(20)] + [("small", "x", "/a", "null", None)]
    records = [(c, d, 1, "completed", {"/a": ('"v"', None)} if int(d, 36) % 2 else {}) for c, d, *_ in gold]
    by = {r.doc_class: r.headline_rate for r in judge.rates(judge.cell_means(judged(spark, gold, records))).filter("pooled = 0").collect()}
    assert by == {"big": 0.5, "small": None}


def test_vocabulary_and_strikes(spark):
    g = spark.createDataFrame([("c", "d", 0, "/x/0/y", 0, "present", '" None "'), ("c", "e", 1, "/x/3/y", 0, "missing", None)], GOLD)
    assert [tuple(r) for r in judge.vocabulary(g).collect()] == [("/x/*/y", "none")]
    r = spark.createDataFrame([("c", "e", 1, "completed", {"/x/3/y": ('"NONE"', 0.4)})], RECORD)
    assert judge.cell_records(g, r).filter("doc = 'e'").first().headline == 1
    struck = spark.createDataFrame([("c", "e", "/x/3/y"), ("c", "d", "/x/0/y")], "doc_class string, doc string, field string")
    assert [x.doc for x in judge.without_struck(g, struck).collect()] == ["d"]


def test_invention_confidence(spark):
    gold = [("c", f"{i}", "/a", "missing", None) for i in range(4)]
    records = [("c", "0", 1, "completed", {"/a": ('"v"', 0.9)}), ("c", "1", 1, "completed", {"/a": ('"v"', 0.7)}), ("c", "2", 1, "completed", {"/a": ("null", 0.2)}), ("c", "3", 1, "completed", {"/a": ("null", 0.4)})]
    cells_, pts = judge.invention_confidence(judged(spark, gold, records))
    assert cells_.agg(F.avg("mean_confidence")).first()[0] == pytest.approx(0.8)
    assert pts.filter("confidence is not null").count() == 4


def test_instability(spark):
    s = spark.createDataFrame([("c", "d", x) for x in "aaaaab"] + [("c", "e", x) for x in "ba"], "doc_class string, doc string, signature string")
    got = {r.doc: (r.repeats, r.divergent, r.modal) for r in judge.instability(s).collect()}
    assert got == {"d": (6, 1, "a"), "e": (2, 1, "a")}


def test_holm(spark):
    t = spark.createDataFrame([(1, 0, 0.01), (1, 1, 0.04), (1, 2, 0.03), (1, 3, 0.005)], "fam int, ord int, p double")
    rows = bootstrap.holm(t, ["fam"]).orderBy("ord").collect()
    assert [round(r.adjusted, 9) for r in rows] == [0.03, 0.06, 0.06, 0.02]
    assert [r.rejected for r in rows] == [True, False, False, True]


def test_interval_equals_the_sequential_one(spark):
    data = [("c", f"{i:02}", float(i % 5), 1 + i % 3) for i in range(12)]
    frame = spark.createDataFrame(data, "doc_class string, doc string, total double, n long")
    mean = lambda x: sum(t for t, _ in x) / sum(n for _, n in x)
    a = bootstrap.pooled_interval(spark, frame, ["doc"], None, resamples=300)
    b = bootstrap.interval_of([[(t, n) for _, _, t, n in data]], mean, resamples=300)
    assert (a.estimate, a.lo, a.hi, a.p_zero) == pytest.approx((b.estimate, b.lo, b.hi, b.p_zero))
    assert bootstrap.interval_of([[3, 3, 3], [3, 3, 3, 3, 3]], lambda x: sum(x) / len(x), resamples=50).method == "degenerate"
    assert bootstrap.pooled_interval(spark, frame.limit(0), ["doc"]) is None


def test_platt_recovers_and_refuses(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.random(4000).round(2)
    y = r.random(4000) < 1 / (1 + np.exp(-(3 * x - 1)))
    pts = spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "ord int, confidence double, correct boolean")
    a, b = calibrate.fit_platt(pts)
    assert a == pytest.approx(3, abs=0.4)
    assert b == pytest.approx(-1, abs=0.25)
    assert calibrate.degenerate(pts) is None
    assert calibrate.degenerate(pts.limit(0)) == "no calibration points"
    assert "one class" in calibrate.degenerate(pts.filter("correct"))
    assert "same" in calibrate.degenerate(pts.withColumn("confidence", F.lit(0.5)))


def test_gate(spark):
    rows = spark.createDataFrame([(0.8, 0.1, 0.81, 0.1), (0.8, 0.1, None, None), (0.8, 0.3, 0.8, 0.1)], "f1 double, ece double, base_f1 double, base_ece double")
    got = [(r.f1_drop, r.ece_rise, r.high_ece, r.passed) for r in calibrate.gate(rows, 0.7, 0.2).collect()]
    assert got == [(True, False, False, False), (False, False, False, True), (False, True, True, False)]


def test_numbering_in_a_global_order(spark):
    from pyspark.sql import functions as F

    from sparkgauge.operators.order import numbered_rows

    rows = [(g, (i * 7919) % 40, at * 1000 + i) for at, (g, m) in enumerate((("a", 500), ("b", 1), ("c", 90), (None, 7))) for i in range(m)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    for by in (["g"], []):
        got = numbered_rows(df, by, ["v", "i"]).collect()
        key = lambda r: ((r[0] is not None, r[0] or "") if by else (), r[1], r[2])  # noqa: B023, E731
        expected, seen = {}, {}
        for r in sorted(rows, key=key):
            own = r[0] if by else 0
            seen.setdefault(own, 0)
            expected[r] = seen[own]
            seen[own] += 1
        assert {(r.g, r.v, r.i): r.r for r in got} == expected
        assert all(r.n == seen[r.g if by else 0] for r in got)
    plan = numbered_rows(df, ["g"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    assert numbered_rows(df.filter(F.lit(False)), ["g"], ["v"]).count() == 0
