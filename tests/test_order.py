"""Runs over ranges, texts against many fields, digests by ranges: against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sparkgauge import cli
from sparkgauge.operators import order, probes, runlog
from sparkgauge.sources import digest


def streaks_by_hand(rows):
    out, last, n = [], None, 0
    for g, k, hit in sorted(rows):
        n = (n if g == last else 0) + 1 if hit else 0
        last = g
        out.append((g, k, n))
    return out


@pytest.mark.parametrize(("share", "partitions"), [(0.5, 3), (0.97, 40), (1.0, 25), (0.0, 4)])
def test_runs_equal_a_loop(spark, share, partitions):
    r = random.Random(partitions)
    # one hot group beside small ones
    rows = [(0 if r.random() < 0.8 else r.randint(1, 4), k, r.random() < share) for k in range(600)]
    frame = spark.createDataFrame(rows, "g long, k long, hit boolean").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = order.runs(frame, ["g"], ["k"], F.col("hit"), "n")
        assert sorted(tuple(x) for x in got.select("g", "k", "n").collect()) == streaks_by_hand(rows)
        one = order.runs(frame, [], ["k"], F.col("hit"), "n").select("k", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((0, *x) for x in one) == streaks_by_hand([(0, k, h) for _, k, h in rows])


def test_streaks_keep_all_columns_and_nulls(spark):
    rows = [("a", 1, "contract_failure"), ("a", 2, None), ("a", 3, "contract_failure"), (None, 1, "contract_failure"), (None, 2, "contract_failure"), ("b", 1, "contract_failure")]
    frame = spark.createDataFrame(rows, "arm string, seq int, availability string").withColumn("extra", F.struct("seq"))
    got = runlog.streaks(frame, ["arm"], ["seq"])
    assert got.columns == [*frame.columns, "streak"]
    assert {(r.arm, r.seq): r.streak for r in got.collect()} == {("a", 1): 1, ("a", 2): 0, ("a", 3): 1, (None, 1): 1, (None, 2): 2, ("b", 1): 1}
    assert runlog.streaks(frame.limit(0), ["arm"], ["seq"]).count() == 0


def test_no_window_by_class(spark):
    plan = runlog.streaks(spark.range(10).selectExpr("id % 2 as arm", "id as seq", "'x' as availability"), ["arm"], ["seq"])._jdf.queryExecution().toString()
    assert "hashpartitioning(arm" not in plan


FIELDS = [("c", "due_date"), ("c", "payee"), ("c", "Ärger_x"), ("c", "date"), ("d", "due_date"), ("d", "_"), ("c", "a")]
TEXTS = [("c", 1, "The DUE DATE, and a due_date"), ("c", 2, "payees"), ("d", 3, "due date"), ("e", 4, "due date payee"), ("c", 5, None), ("c", 6, ""), ("c", 7, "ÄRGER X dat"), (None, 8, "due date"), ("d", 9, "updated due-date")]


def hits_by_hand():
    out = set()
    for c, doc, text in TEXTS:
        for k, field in FIELDS:
            if c == k and text is not None:
                spaced = field.replace("_", " ").strip()
                for t in [field] if spaced == field else [field, spaced]:
                    if t.lower() in text.lower():
                        out.add((c, doc, field, t))
                        break
    return out


@pytest.mark.parametrize("most", [2_000_000, 20, 1])
def test_hits_equal_a_loop_whatever_the_lots(spark, most):
    texts, fields = spark.createDataFrame(TEXTS, "doc_class string, doc long, text string"), spark.createDataFrame(FIELDS, "doc_class string, field string")
    assert {tuple(r) for r in probes.text_hits(texts, fields, most).collect()} == hits_by_hand()


def test_texts_are_not_repeated_by_field(spark):
    texts, fields = spark.createDataFrame(TEXTS, "doc_class string, doc long, text string"), spark.createDataFrame(FIELDS, "doc_class string, field string")
    plan = probes.text_hits(texts, fields)._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert probes.text_hits(texts, fields.limit(0)).count() == 0


def put(folder, *parts):
    folder.mkdir()
    for i, text in enumerate(parts):
        (folder / f"part-{i:05}").write_text(text)
    return str(folder)


def test_digests_tell_where_tables_differ(spark, tmp_path):
    lines = [f"line {i}\n" for i in range(500)]
    a, b = put(tmp_path / "a", "".join(lines)), put(tmp_path / "b", "".join(lines[:3]), "".join(lines[3:450]), "".join(lines[450:]))
    assert digest.path_digest(spark, a) == digest.path_digest(spark, b)
    assert digest.difference(spark, a, b, 64) is None
    other = list(lines)
    other[200], other[201] = other[201], other[200]
    other[400] = "x\n"
    c, d = put(tmp_path / "c", "".join(other)), put(tmp_path / "d", "".join(lines[:-1]))
    assert digest.difference(spark, a, c, 64) == digest.Difference(192, 256, (64, 64))
    assert digest.difference(spark, a, d, 64) == digest.Difference(448, 500, (52, 51))
    assert digest.path_digest(spark, a) != digest.path_digest(spark, d)
    e = put(tmp_path / "e", "")
    assert digest.difference(spark, e, e) is None
    assert digest.difference(spark, e, d, 64) == digest.Difference(0, 64, (0, 64))


def test_dataset_check_verb(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    a, b, c = put(tmp_path / "a", "1\n2\n", "3\n"), put(tmp_path / "b", "1\n", "2\n3\n"), put(tmp_path / "c", "1\n3\n2\n")
    assert cli.main(["dataset-check", "--a", a, "--b", b]) == 0
    assert cli.main(["dataset-check", "--a", a, "--b", c]) == 1
    assert "lines 1 to 3 differ" in capsys.readouterr().err
