"""Registered queries over the driver's tables, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng, text, values
from ..operators import adapters, bootstrap, calibrate, cells, corpora, dataset, judge, metrics, probes, requests, runlog, simulate
from ..sources import checkpoint, digest, sinks
from . import matrix, views
from .views import CELLS, JUDGED, POINTS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_rounding(inner: str, columns: str, doubles: str, ctes: str = "") -> str:
    cols = ", ".join([*[c for c in columns.split() if c], *[f"round({d}, 6) AS {d}" for d in doubles.split()]])
    return f"{'WITH ' + ctes if ctes else ''} SELECT {cols} FROM ({inner})"


# --- cells -----------------------------------------------------------------------------

_JOINED = CELLS + """,
joined AS (
  SELECT g.*, p.repeat, coalesce(p.confidence, 0.5) AS conf, p.value_json AS pred_json,
    CASE WHEN p.field IS NULL THEN 'missing' WHEN p.value_json = 'null' THEN 'null' ELSE 'present' END AS pred_state
  FROM goldens g LEFT JOIN (SELECT * FROM predictions WHERE repeat = 1) p USING (doc_class, doc, field)),
counted AS (
  SELECT *, CAST(pred_state = 'present' AND hit AS BIGINT) AS tp, CAST(pred_state = 'present' AND NOT hit AS BIGINT) AS fp,
    CAST(state = 'present' AND NOT (pred_state = 'present' AND hit) AS BIGINT) AS fn
  FROM (SELECT *, state = 'present' AND pred_state = 'present' AND pred_json = value_json AS hit FROM joined))"""
_PRF = """sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
  CASE WHEN sum(tp) + sum(fp) = 0 THEN 1.0 ELSE sum(tp) / (sum(tp) + sum(fp))::DOUBLE END AS precision,
  CASE WHEN sum(tp) + sum(fn) = 0 THEN 1.0 ELSE sum(tp) / (sum(tp) + sum(fn))::DOUBLE END AS recall"""
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"


def _counted(spark: SparkSession, sf: str, repeat: int = 1) -> DataFrame:
    p = views.predictions(spark, sf).filter(F.col("repeat") == repeat)
    return cells.confusion(cells.correctness(cells.join_cells(views.goldens(spark, sf), p)))


@query(f"WITH {_JOINED} SELECT doc_class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM (SELECT doc_class, {_PRF} FROM counted GROUP BY 1)")
def q_confusion_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cells.score_table(_counted(spark, sf), ["doc_class"]))


@query(f"WITH {_JOINED} SELECT doc_class, doc, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM (SELECT doc_class, doc, {_PRF} FROM counted GROUP BY 1, 2)")
def q_document_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cells.score_table(_counted(spark, sf), ["doc_class", "doc"]))


@query(f"WITH {_JOINED} SELECT round(avg({_F1}), 6) AS macro_f1 FROM (SELECT doc_class, {_PRF} FROM counted GROUP BY 1)")
def q_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cells.macro_mean(cells.score_table(_counted(spark, sf), ["doc_class"]), []))


_REPEATS = CELLS + """,
counted AS (
  SELECT *, CAST(said AND hit AS BIGINT) AS tp, CAST(said AND NOT hit AS BIGINT) AS fp, CAST(state = 'present' AND NOT (said AND hit) AS BIGINT) AS fn
  FROM (SELECT g.doc_class, r.repeat, g.state, p.field IS NOT NULL AND p.value_json <> 'null' AS said,
          coalesce(g.state = 'present' AND p.value_json <> 'null' AND p.value_json = g.value_json, false) AS hit
        FROM goldens g CROSS JOIN (SELECT unnest([1, 2, 3]) AS repeat) r LEFT JOIN predictions p ON p.doc_class = g.doc_class AND p.doc = g.doc AND p.field = g.field AND p.repeat = r.repeat))"""


@query(f"WITH {_REPEATS} SELECT doc_class, round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, count(*) AS repeats FROM (SELECT *, {_F1} AS f1 FROM (SELECT doc_class, repeat, {_PRF} FROM counted GROUP BY 1, 2)) GROUP BY 1")
def q_mean_over_repeats(spark: SparkSession, sf: str) -> DataFrame:
    g, p = views.goldens(spark, sf), views.predictions(spark, sf)
    # each repeat is scored against the whole golden set
    g = g.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))).withColumn("doc", F.struct("doc", "repeat"))
    p = p.withColumn("doc", F.struct("doc", "repeat"))
    scores = cells.score_table(cells.confusion(cells.correctness(cells.join_cells(g, p.drop("repeat")))), ["doc_class", "repeat"])
    return rounded(matrix.mean_over_repeats(scores, ("doc_class",)))


@query("""
WITH c AS (
  SELECT o_orderstatus AS doc_class, o_orderkey AS doc, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey % 4 AS k FROM orders),
f AS (SELECT *, CASE k WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN '$' || format('{:,}', v) WHEN 2 THEN '(' || v || '.50)' ELSE CAST(v + 1 AS VARCHAR) END AS p FROM c)
SELECT doc_class, "column", sum(hit)::BIGINT AS tp, sum(1 - hit)::BIGINT AS fp, sum(1 - hit)::BIGINT AS fn
FROM (SELECT doc_class, 'strict' AS "column", CAST(p = CAST(v AS VARCHAR) AS INTEGER) AS hit FROM f
      UNION ALL SELECT doc_class, 'normalized', CAST(k IN (0, 1) AS INTEGER) FROM f) GROUP BY ALL""")
def q_dual_columns(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("doc_class"), F.col("o_orderkey").alias("doc"), F.floor("o_totalprice").alias("v"), (F.col("o_orderkey") % 4).alias("k"))
    v = F.col("v").cast("string")
    said = F.when(F.col("k") == 0, v).when(F.col("k") == 1, F.concat(F.lit("$"), F.format_number("v", 0))).when(F.col("k") == 2, F.concat(F.lit("("), v, F.lit(".50)"))).otherwise((F.col("v") + 1).cast("string"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    field = F.lit("/total").alias("field")
    g = o.select("doc_class", "doc", F.col("doc").alias("doc_ord"), field, F.lit(0).alias("field_ord"), F.lit("present").alias("state"), quoted(v).alias("value_json"))
    p = o.select("doc_class", "doc", field, quoted(said).alias("value_json"), F.lit(0.5).alias("confidence"))
    rules = o.select("doc_class").distinct().select("doc_class", F.lit("/total").alias("pattern"), F.lit("currency").alias("kind"))
    return cells.score_table(cells.dual_columns(cells.join_cells(g, p), rules), ["doc_class", "column"]).select("doc_class", "column", "tp", "fp", "fn")


@query(f"WITH {CELLS} SELECT doc_class, doc FROM (SELECT DISTINCT doc_class, doc FROM goldens) WHERE (doc_class, doc) NOT IN (SELECT (doc_class, doc) FROM predictions WHERE repeat = 2)")
def q_unmatched_documents(spark: SparkSession, sf: str) -> DataFrame:
    return cells.unmatched(views.goldens(spark, sf), views.predictions(spark, sf).filter("repeat = 2"))


@query(f"WITH {CELLS} SELECT DISTINCT doc_class, doc FROM records WHERE (doc_class, doc) NOT IN (SELECT (doc_class, doc) FROM goldens WHERE state = 'missing')")
def q_unknown_documents(spark: SparkSession, sf: str) -> DataFrame:
    return cells.unknown_documents(views.goldens(spark, sf).filter("state = 'missing'"), views.records(spark, sf))


# --- metrics ---------------------------------------------------------------------------

_BINS = """binned AS (
  SELECT *, ((r + 1) * least({k}, n) - 1) // n AS bin FROM (
    SELECT *, row_number() OVER (PARTITION BY cls ORDER BY confidence, doc, ln) - 1 AS r, count(*) OVER (PARTITION BY cls) AS n FROM points)),
bins AS (SELECT cls, bin, count(*) AS bin_n, avg(confidence) AS mean_confidence, avg(correct::INTEGER) AS accuracy FROM binned GROUP BY 1, 2)"""


def _bins_sql(k: int) -> str:
    return POINTS + ", " + _BINS.format(k=k)


@query(with_rounding("SELECT * FROM bins", "cls bin bin_n", "mean_confidence accuracy", _bins_sql(15)))
def q_reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.reliability(views.points(spark, sf), ["cls"], ["doc", "ln"]))


_ECE = """SELECT cls, round(sum(bin_n * abs(accuracy - mean_confidence)) / sum(bin_n), 6) AS ece,
  round(sqrt(greatest(0, sum(bin_n * ((accuracy - mean_confidence) ** 2 - CASE WHEN bin_n > 1 THEN accuracy * (1 - accuracy) / (bin_n - 1) ELSE 0 END)) / sum(bin_n))), 6) AS debiased_ece
  FROM bins GROUP BY cls"""


@query(f"WITH {_bins_sql(15)} {_ECE}")
def q_ece_15(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.ece(views.points(spark, sf), ["cls"], ["doc", "ln"]))


@query(f"WITH {_bins_sql(10)} {_ECE}")
def q_ece_10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.ece(views.points(spark, sf), ["cls"], ["doc", "ln"], 10))


@query(f"WITH {POINTS} SELECT cls, round(avg((confidence - correct::INTEGER) ** 2), 6) AS brier FROM points GROUP BY 1")
def q_brier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.brier(views.points(spark, sf), ["cls"]))


_AUROC = """SELECT cls, CASE WHEN p = 0 OR p = n THEN 0.5 ELSE round((sum(CASE WHEN correct THEN r END) - p * (p + 1) / 2.0) / (p * (n - p)), 6) END AS auroc FROM (
  SELECT cls, correct, rank() OVER (PARTITION BY cls ORDER BY confidence) + (count(*) OVER (PARTITION BY cls, confidence) - 1) / 2.0 AS r,
    sum(correct::INTEGER) OVER (PARTITION BY cls)::DOUBLE AS p, count(*) OVER (PARTITION BY cls)::DOUBLE AS n FROM points) GROUP BY cls, p, n"""


@query(f"WITH {POINTS} {_AUROC}")
def q_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.auroc(views.points(spark, sf), ["cls"]))


@query("""WITH p AS (SELECT d.lang AS cls, least(1.0, d.n_chars / 10000.0)::DOUBLE AS confidence, l.quality = 1 AS correct FROM documents d JOIN labels l USING (doc_id)),
points AS (SELECT * FROM p) """ + _AUROC)
def q_auroc_quality_labels(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")  # noqa: E741
    p = d.join(l, "doc_id").select(F.col("lang").alias("cls"), F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("confidence"), (F.col("quality") == 1).alias("correct"))
    return rounded(metrics.auroc(p, ["cls"]))


_CURVE = POINTS + """, steps AS (SELECT cls, confidence, count(*) AS m, sum(correct::INTEGER) AS y FROM points GROUP BY 1, 2),
curve AS (SELECT cls, confidence AS threshold, sum(m) OVER w / sum(m) OVER (PARTITION BY cls)::DOUBLE AS coverage, 1 - sum(y) OVER w / (sum(m) OVER w)::DOUBLE AS error
  FROM steps WINDOW w AS (PARTITION BY cls ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_CURVE} SELECT cls, round(threshold, 6) AS threshold, round(coverage, 6) AS coverage, round(error, 6) AS error FROM curve UNION ALL SELECT DISTINCT cls, NULL, 0.0, 0.0 FROM points")
def q_risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.risk_coverage(views.points(spark, sf), ["cls"]))


@query(f"WITH {_CURVE} SELECT cls, target, round(arg_min(error, coverage), 6) AS error, round(min(coverage), 6) AS coverage FROM curve, (SELECT unnest([0.7, 0.8, 0.9, 1.0])::DOUBLE AS target) WHERE coverage >= target - 1e-12 GROUP BY 1, 2")
def q_error_at_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.error_at_coverage(views.points(spark, sf), ["cls"], [0.7, 0.8, 0.9, 1.0]))


@query(f"WITH {_CURVE} SELECT cls, budget, round(max(CASE WHEN error <= budget + 1e-12 THEN coverage ELSE 0 END), 6) AS coverage FROM (SELECT cls, coverage, error FROM curve UNION ALL SELECT DISTINCT cls, 0.0, 0.0 FROM points), (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS budget) GROUP BY 1, 2")
def q_coverage_at_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.coverage_at_error(views.points(spark, sf), ["cls"], [0.1, 0.3, 0.5]))


@query(f"WITH {_CURVE} SELECT cls, round(arg_max(threshold, coverage), 6) AS tau, round(max(coverage), 6) AS coverage, round(arg_max(error, coverage), 6) AS error FROM curve WHERE error <= 0.67 GROUP BY 1")
def q_selective_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.selective_threshold(views.points(spark, sf), ["cls"], 0.67))


@query(f"WITH {POINTS} SELECT cls, bucket, n, round(accuracy, 6) AS accuracy, round(claimed, 6) AS claimed, round(n / sum(n) OVER (PARTITION BY cls), 6) AS share FROM (SELECT cls, least(9, greatest(0, floor(confidence * 10)))::INTEGER AS bucket, count(*) AS n, avg(correct::INTEGER) AS accuracy, avg(confidence) AS claimed FROM points GROUP BY 1, 2)")
def q_confidence_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.confidence_buckets(views.points(spark, sf), ["cls"]))


_INTERVALS = """SELECT event_type AS name, avg(value) AS estimate, avg(value) - 2 * stddev_samp(value) / sqrt(count(*)) AS lo, avg(value) + 2 * stddev_samp(value) / sqrt(count(*)) AS hi FROM events GROUP BY 1"""


@query(f"""WITH i AS ({_INTERVALS}), o AS (
  SELECT *, lo <= coalesce(min(hi) OVER w, lo) AND hi >= coalesce(max(lo) OVER w, hi) AS ok FROM i WINDOW w AS (ORDER BY estimate DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT name, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, min(ok) OVER (ORDER BY estimate DESC, name ROWS UNBOUNDED PRECEDING) AS tied FROM o""")
def q_tie_groups(spark: SparkSession, sf: str) -> DataFrame:
    half = 2 * F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))
    i = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("estimate"), (F.avg("value") - half).alias("lo"), (F.avg("value") + half).alias("hi"))
    return rounded(metrics.tie_groups(i, [], ["name"]))


# --- judge -----------------------------------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return judge.cell_records(views.goldens(spark, sf), views.records(spark, sf))


@query(f"WITH {JUDGED} SELECT * FROM vocabulary")
def q_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return judge.vocabulary(views.goldens(spark, sf))


@query(f"WITH {JUDGED} SELECT doc_class, doc, field, state, round(headline, 6) AS headline, round(strict, 6) AS strict, round(dual, 6) AS dual FROM means")
def q_cell_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(judge.cell_means(_judged(spark, sf)))


@query(f"""WITH {JUDGED},
g AS (SELECT doc_class, grouping(doc_class) AS pooled,
  avg(headline) FILTER (state <> 'present') AS headline_rate, count(headline) FILTER (state <> 'present') AS headline_cells,
  avg(strict) FILTER (state <> 'present') AS strict_rate, count(strict) FILTER (state <> 'present') AS strict_cells,
  avg(dual) FILTER (state <> 'present') AS dual_rate, count(dual) FILTER (state <> 'present') AS dual_cells,
  avg(headline) FILTER (state = 'present') AS answered_rate, count(headline) FILTER (state = 'present') AS answered_cells,
  count(*) FILTER (state <> 'present' AND headline IS NULL) AS excluded_cells
  FROM means GROUP BY GROUPING SETS ((), (doc_class)))
SELECT doc_class, CAST(pooled AS INTEGER) AS pooled, headline_cells, strict_cells, dual_cells, answered_cells, excluded_cells,
  CASE WHEN pooled = 1 OR headline_cells >= 20 THEN round(headline_rate, 6) END AS headline_rate, round(strict_rate, 6) AS strict_rate,
  round(dual_rate, 6) AS dual_rate, round(answered_rate, 6) AS answered_rate FROM g""")
def q_fabrication_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(judge.rates(judge.cell_means(_judged(spark, sf)))).withColumn("pooled", F.col("pooled").cast("int"))


@query(f"""WITH {CELLS} SELECT repeat, count(*) AS attempted, count(*) FILTER (availability = 'completed') AS completed,
  count(*) FILTER (availability = 'transport_failure') AS transport_failures, count(*) FILTER (availability = 'contract_failure') AS contract_failures,
  round(count(*) FILTER (availability = 'completed') / count(*)::DOUBLE, 6) AS availability FROM records GROUP BY GROUPING SETS ((), (repeat))""")
def q_availability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(judge.availability(views.records(spark, sf)))


_SIGNED = CELLS + """, signed AS (SELECT doc_class, doc, repeat, CAST(max(eid % 3) AS VARCHAR) AS signature FROM base GROUP BY 1, 2, 3)"""


@query(f"""WITH {_SIGNED}, c AS (SELECT doc_class, doc, signature, count(*) AS m FROM signed GROUP BY 1, 2, 3)
SELECT doc_class, doc, sum(m)::BIGINT AS repeats, (sum(m) - max(m))::BIGINT AS divergent, (SELECT x.signature FROM c x WHERE x.doc_class = c.doc_class AND x.doc = c.doc ORDER BY m DESC, signature LIMIT 1) AS modal FROM c GROUP BY doc_class, doc""")
def q_instability(spark: SparkSession, sf: str) -> DataFrame:
    s = views.base(spark, sf).groupBy("doc_class", "doc", "repeat").agg(F.max(F.col("eid") % 3).cast("string").alias("signature"))
    return judge.instability(s)


@query(f"WITH {CELLS} SELECT g.doc_class, g.doc, g.field, g.state FROM goldens g LEFT JOIN strikes s USING (doc_class, doc, field) WHERE g.state = 'present' OR s.field IS NULL")
def q_without_struck(spark: SparkSession, sf: str) -> DataFrame:
    return judge.without_struck(views.goldens(spark, sf), views.strikes(spark, sf)).select("doc_class", "doc", "field", "state")


@query(f"WITH {JUDGED} SELECT doc_class, doc, field, round(avg(confidence), 6) AS mean_confidence FROM verdicts WHERE state <> 'present' AND usable AND headline = 1 AND confidence IS NOT NULL GROUP BY 1, 2, 3")
def q_invention_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(judge.invention_confidence(_judged(spark, sf))[0])


@query(f"""WITH {JUDGED}, steps AS (SELECT confidence, count(*) AS m, sum(1 - headline) AS y FROM verdicts WHERE state <> 'present' AND usable AND confidence IS NOT NULL GROUP BY 1)
SELECT round(confidence, 6) AS threshold, round(sum(m) OVER w / sum(m) OVER (), 6) AS coverage, round(1 - sum(y) OVER w / sum(m) OVER w, 6) AS error FROM steps WINDOW w AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)""")
def q_invention_risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    points = judge.invention_confidence(_judged(spark, sf))[1].filter("confidence is not null")
    return rounded(metrics.risk_coverage(points, [], sentinel=False))


# --- statistics ------------------------------------------------------------------------

def _mulberry(n: str, rows: str | None = None) -> str:
    """SQL: ``i, u`` of the first n draws, or of those that ``rows`` names (``i``).  A product of two words is taken modulo 2^32 in halves, so 64 bits are enough."""
    word, times = (lambda x: f"(({x}) & 4294967295)"), (lambda a, b: f"((({a}) * (({b}) & 65535) + (((({a}) * (({b}) >> 16)) & 65535) << 16)) & 4294967295)")
    return f"""(SELECT i, xor(t3, t3 >> 14) / 4294967296.0 AS u FROM (
      SELECT i, xor({word(f"t2 + {times('w', 't2 | 61')}")}, t2) AS t3 FROM (SELECT i, t2, xor(t2, t2 >> 7) AS w FROM (
        SELECT i, {times('x', 'a | 1')} AS t2 FROM (SELECT i, a, xor(a, a >> 15) AS x FROM (
          SELECT i, {word(f"{bootstrap.SEED} + {times('1831565813', word('i + 1'))}")} AS a FROM {rows or f'range({n})'} t(i)))))))"""


@query(f"SELECT i AS draw, u FROM {_mulberry('', '(SELECT o_orderkey FROM orders)')}")
def q_random_stream(spark: SparkSession, sf: str) -> DataFrame:
    return rng.with_uniform(table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw")), bootstrap.SEED, F.col("draw"), "u")


#: The class whose documents the simulations take, and the arm that others are held against.
_BASE = "view"
_CLUSTERS = """clusters AS (SELECT *, row_number() OVER (ORDER BY doc_class, doc) - 1 AS pos, count(*) OVER () AS size FROM (
  SELECT event_type AS doc_class, user_id AS doc, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2))"""
_RESAMPLED = _CLUSTERS + f""", draws AS (SELECT i // (SELECT count(*) FROM clusters) AS b, u FROM {_mulberry(f'(SELECT {bootstrap.RESAMPLES} * count(*) FROM clusters)')}),
sums AS (SELECT b, sum(total) AS total, sum(n)::BIGINT AS n FROM draws JOIN clusters ON pos = floor(u * size)::BIGINT GROUP BY 1)"""


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("doc_class"), F.col("user_id").alias("doc")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RESAMPLED} SELECT b, round(total, 3) AS total, n FROM sums")
def q_bootstrap_means(spark: SparkSession, sf: str) -> DataFrame:
    placed = bootstrap.numbered(_clusters(spark, sf), ["doc_class", "doc"])
    return bootstrap.resample_sums(spark, placed).select("b", F.round("total", 3).alias("total"), "n")


@query(f"WITH {_RESAMPLED} SELECT 'all' AS name, round(quantile_cont(total / n, 0.025), 6) AS lo, round(quantile_cont(total / n, 0.975), 6) AS hi, round(avg(total / n), 6) AS mean FROM sums")
def q_percentile_interval(spark: SparkSession, sf: str) -> DataFrame:
    placed = bootstrap.numbered(_clusters(spark, sf), ["doc_class", "doc"])
    sums = bootstrap.resample_sums(spark, placed).withColumn("name", F.lit("all"))
    return rounded(bootstrap.percentile_interval(sums, ["name"]))


@query(f"WITH {_CLUSTERS} SELECT doc_class, doc, round((sum(total) OVER w - total) / (sum(n) OVER w - n), 6) AS jack FROM clusters WINDOW w AS (PARTITION BY doc_class)")
def q_jackknife(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bootstrap.jackknife(_clusters(spark, sf), ["doc_class"]).select("doc_class", "doc", "jack"))


@query()
def q_pooled_interval(spark: SparkSession, sf: str) -> DataFrame:
    means = judge.cell_means(_judged(spark, sf))
    sums = judge.document_sums(means, "headline", F.col("state") != "present")
    ci = bootstrap.pooled_interval(spark, sums, ["doc_class", "doc"], None)
    rows = [] if ci is None else [(ci.estimate, ci.lo, ci.hi, ci.method, ci.p_zero)]
    return spark.createDataFrame(rows, "estimate double, lo double, hi double, method string, p_zero double")


def _cluster_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(spark, sf).groupBy("doc_class", "doc").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


#: Draw k of a resample goes to the class of the cluster at place k.
@query(f"""WITH {_JOINED}, per AS (SELECT doc_class, doc, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counted GROUP BY 1, 2),
clusters AS (SELECT *, row_number() OVER (ORDER BY doc_class, doc) - 1 AS pos FROM per),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_class) AS size, min(pos) OVER (PARTITION BY doc_class) AS before FROM clusters),
draws AS (SELECT i // (SELECT count(*) FROM clusters) AS b, i % (SELECT count(*) FROM clusters) AS k, u FROM {_mulberry(f'(SELECT {bootstrap.RESAMPLES} * count(*) FROM clusters)')}),
drawn AS (SELECT b, before + floor(u * size)::BIGINT AS pos FROM draws JOIN sized ON pos = k)
SELECT b, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM drawn JOIN clusters USING (pos) GROUP BY 1""")
def q_pooled_f1_sums(spark: SparkSession, sf: str) -> DataFrame:
    placed = bootstrap.numbered(_cluster_cells(spark, sf), ["doc_class", "doc"], "doc_class")
    return bootstrap.resample_vectors(spark, placed, ["tp", "fp", "fn"])


#: No SQL: its normal quantiles; the sums have one, and a test compares intervals with a loop.
@query()
def q_f1_intervals(spark: SparkSession, sf: str) -> DataFrame:
    clusters = _cluster_cells(spark, sf)
    classes = sorted(r.doc_class for r in clusters.select("doc_class").distinct().collect())
    wide, columns = bootstrap.by_class(clusters, classes, ["tp", "fp", "fn"])
    closings = {"pooled": bootstrap.pooled_f1, "macro": bootstrap.macro_f1(len(classes))} | {c: (lambda s, i=i: bootstrap.pooled_f1(lambda x: s(f"{x}{i}"))) for i, c in enumerate(classes)}
    found = bootstrap.resampled(spark, wide, ["tp", "fp", "fn", *columns], closings, ["doc_class", "doc"], "doc_class")
    rows = [(name, ci.estimate, ci.lo, ci.hi, ci.method) for name, r in found.items() for ci in [r.interval()]]
    return rounded(spark.createDataFrame(rows, "name string, estimate double, lo double, hi double, method string"))


@query(f"""WITH m AS (SELECT event_type AS arm, user_id AS doc, avg(value) AS v FROM events GROUP BY 1, 2),
base AS (SELECT doc, v, row_number() OVER (ORDER BY doc) - 1 AS pos FROM m WHERE arm = '{_BASE}'),
pairs AS (SELECT m.arm, b.pos, m.v - b.v AS d FROM m JOIN base b USING (doc) WHERE m.arm <> '{_BASE}'),
est AS (SELECT arm, avg(d) AS estimate, sum(d) AS total, count(*) AS docs FROM pairs GROUP BY 1),
draws AS (SELECT i // (SELECT count(*) FROM base) AS b, floor(u * (SELECT count(*) FROM base))::BIGINT AS pos FROM {_mulberry(f'(SELECT {bootstrap.RESAMPLES} * count(*) FROM base)')}),
times AS (SELECT b, pos, count(*) AS k FROM draws GROUP BY 1, 2),
boot AS (SELECT arm, b, sum(k * d) / sum(k) AS s FROM times JOIN pairs USING (pos) GROUP BY 1, 2),
p AS (SELECT arm, least(1, 2 * least((1 + count(*) FILTER (s <= 0)) / (count(*) + 1.0), (1 + count(*) FILTER (s >= 0)) / (count(*) + 1.0))) AS p,
  (count(*) FILTER (s < estimate) + count(*) FILTER (s = estimate) / 2) / count(*) AS below FROM boot JOIN est USING (arm) GROUP BY 1),
jack AS (SELECT e.arm, (e.total - coalesce(d, 0)) / (docs - (d IS NOT NULL)::INT) AS v FROM est e CROSS JOIN base b LEFT JOIN pairs p ON p.arm = e.arm AND p.pos = b.pos),
away AS (SELECT arm, avg(v) OVER (PARTITION BY arm) - v AS x FROM jack), a AS (SELECT arm, sum(x ** 3) / (6 * sum(x ** 2) ** 1.5) AS acceleration FROM away GROUP BY 1),
s AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p, arm) + 1 AS k FROM p)
SELECT arm AS contrast, docs, round(estimate, 6) AS estimate, round(below, 6) AS below, round(acceleration, 6) AS acceleration, round(p, 6) AS p,
  round(max(least(1.0, k * p)) OVER w, 6) AS adjusted, round(0.05 / k, 6) AS step_alpha, min(p <= 0.05 / k) OVER w AS rejected
FROM s JOIN est USING (arm) JOIN a USING (arm) WINDOW w AS (ORDER BY p, arm ROWS UNBOUNDED PRECEDING)""")
def q_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    values = e.groupBy(F.col("event_type").alias("arm"), F.lit("all").alias("doc_class"), F.col("user_id").alias("doc")).agg(F.avg("value").alias("value"))
    found = bootstrap.contrasts(spark, values, _BASE)
    return rounded(found.select("contrast", "docs", "estimate", "below", "acceleration", "p", "adjusted", "step_alpha", "rejected"))


_PAIRED = """a AS (SELECT event_type AS doc_class, user_id AS doc, avg(value) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT event_type AS doc_class, user_id AS doc, avg(value) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)"""


@query(f"WITH {_PAIRED} SELECT doc_class, doc, round(a.m - b.m, 6) AS total, 1::BIGINT AS n FROM a JOIN b USING (doc_class, doc)")
def q_paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    side = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("doc_class"), F.col("user_id").alias("doc")).agg(F.avg("value").alias("m"))
    return rounded(bootstrap.paired_deltas(side(0), side(1), "m"))


_TESTS = "SELECT n_regionkey AS fam, n_nationkey AS ord, ((n_nationkey * 37) % 100) / 1000.0::DOUBLE AS p FROM nation"


@query(f"""WITH t AS ({_TESTS}), s AS (SELECT *, count(*) OVER (PARTITION BY fam) - row_number() OVER w + 1 AS k FROM t WINDOW w AS (PARTITION BY fam ORDER BY p, ord))
SELECT fam, ord, p, round(max(least(1.0, k * p)) OVER w, 6) AS adjusted, round(0.05 / k, 6) AS step_alpha, min(p <= 0.05 / k) OVER w AS rejected FROM s WINDOW w AS (PARTITION BY fam ORDER BY p, ord ROWS UNBOUNDED PRECEDING)""")
def q_holm(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "nation").select(F.col("n_regionkey").alias("fam"), F.col("n_nationkey").alias("ord"), ((F.col("n_nationkey") * 37 % 100) / 1000.0).alias("p"))
    return rounded(bootstrap.holm(t, ["fam"])).select("fam", "ord", "p", "adjusted", "step_alpha", "rejected")


#: No SQL: 60 million draws of these points are too many for it; a test compares a small table with a loop.
@query()
def q_consistency_bands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(simulate.consistency_bands(views.points(spark, sf), ["doc", "ln"], bootstrap.SEED))


#: No SQL for these two: rejection draws; tests compare them with published figures.  Sizes are those of the classes' documents, fields those of each document of a class.
@query()
def q_noise_floor(spark: SparkSession, sf: str) -> DataFrame:
    sizes = views.goldens(spark, sf).groupBy("doc_class").agg(F.count_distinct("doc").alias("n")).select("n").distinct()
    return simulate.noise_floor(spark, sorted(r.n for r in sizes.collect()), bootstrap.SEED)  # a row a class


@query()
def q_detectable_effect(spark: SparkSession, sf: str) -> DataFrame:
    per = views.goldens(spark, sf).filter(F.col("doc_class") == _BASE).groupBy("doc").agg(F.count(F.lit(1)).alias("fields"))
    found = simulate.detectable_effect(spark, per, 0.75, [0.05, 0.1, 0.2], bootstrap.SEED, order=["doc"])
    return spark.createDataFrame(found["grid"], "delta double, power double")


#: Newton steps of the ridged fit over counts by confidence, as many as the fit needs to stand still.
@query(f"""WITH RECURSIVE {POINTS}, c AS (SELECT confidence AS x, count(*)::DOUBLE AS m, sum(correct::INTEGER)::DOUBLE AS y FROM points GROUP BY 1),
it AS (SELECT 0 AS k, 0::DOUBLE AS a, 0::DOUBLE AS b UNION ALL
  SELECT k + 1, (szx * sw - swx * sz) / ((swxx + {calibrate.RIDGE}) * sw - swx * swx), ((swxx + {calibrate.RIDGE}) * sz - swx * szx) / ((swxx + {calibrate.RIDGE}) * sw - swx * swx)
  FROM (SELECT k, sum(w * m) AS sw, sum(w * m * x) AS swx, sum(w * m * x * x) AS swxx, sum(z) AS sz, sum(z * x) AS szx FROM (
    SELECT k, x, m, greatest(mu * (1 - mu), {calibrate.WEIGHT_FLOOR}) AS w, greatest(mu * (1 - mu), {calibrate.WEIGHT_FLOOR}) * m * eta + y - m * mu AS z
    FROM (SELECT k, x, m, y, a * x + b AS eta, 1 / (1 + exp(-(a * x + b))) AS mu FROM it, c WHERE k < 30)) GROUP BY k))
SELECT round(a, 6) AS a, round(b, 6) AS b FROM it WHERE k = 30""")
def q_platt(spark: SparkSession, sf: str) -> DataFrame:
    a, b = calibrate.fit_platt(views.points(spark, sf))
    return rounded(spark.createDataFrame([(a, b)], "a double, b double"))


_ABLATION = """SELECT cls AS variant, ece, brier FROM e JOIN b USING (cls)"""


@query(f"""WITH base AS ({'SELECT l_orderkey AS doc, l_linenumber AS ln, l_discount * 10 AS confidence, l_returnflag = ' + "'N'" + ' AS correct FROM lineitem'}),
points AS (SELECT 'full' AS cls, * FROM base UNION ALL SELECT 'half', doc, ln, confidence / 2, correct FROM base UNION ALL SELECT 'same', * FROM base),
{_BINS.format(k=15)}, e AS ({_ECE}), b AS (SELECT cls, avg((confidence - correct::INTEGER) ** 2) AS brier FROM points GROUP BY 1)
SELECT cls AS variant, cls = 'same' AS degenerate, CASE WHEN cls <> 'same' THEN round(brier - (SELECT brier FROM b WHERE cls = 'full'), 5) END AS d_brier FROM e JOIN b USING (cls) WHERE cls <> 'full'""")
def q_ablation(spark: SparkSession, sf: str) -> DataFrame:
    p = views.points(spark, sf).select("doc", "ln", "confidence", "correct")
    rows = p.withColumn("variant", F.lit("full")).unionByName(p.withColumn("variant", F.lit("half")).withColumn("confidence", F.col("confidence") / 2)).unionByName(p.withColumn("variant", F.lit("same")))
    return calibrate.ablation(rows, "full", ["doc", "ln"]).select("variant", "degenerate", F.round("d_brier", 5).alias("d_brier"))


#: Per class: its F1, the ECE of points, and a baseline that is the same class of another repeat, moved so that each flag is raised somewhere.
@query(f"""WITH {_JOINED}, {_bins_sql(15)}, e AS ({_ECE}), f AS (SELECT doc_class, {_F1} AS f1 FROM (SELECT doc_class, {_PRF} FROM counted GROUP BY 1)),
k AS (SELECT *, row_number() OVER (ORDER BY doc_class) AS k FROM f), g AS (SELECT ece, row_number() OVER (ORDER BY cls) AS k FROM e),
now AS (SELECT doc_class, f1, ece, CASE WHEN k.k % 2 = 0 THEN f1 + 0.01 ELSE f1 + 0.004 END AS base_f1, CASE WHEN k.k % 3 = 0 THEN ece - 0.01 WHEN k.k % 3 = 1 THEN ece END AS base_ece
  FROM k JOIN g ON g.k = (k.k - 1) % (SELECT count(*) FROM g) + 1),
flags AS (SELECT doc_class, f1 < (SELECT quantile_disc(f1, 0.5) FROM f) AS low_f1, ece > (SELECT min(ece) FROM e) AS high_ece, base_f1 - f1 > 0.005 AS f1_drop, coalesce(ece - base_ece > 0.005, false) AS ece_rise FROM now)
SELECT *, NOT (low_f1 OR high_ece OR f1_drop OR ece_rise) AS passed FROM flags""")
def q_gate(spark: SparkSession, sf: str) -> DataFrame:
    f = cells.score_table(_counted(spark, sf), ["doc_class"]).select("doc_class", "f1")
    e = metrics.ece(views.points(spark, sf), ["cls"], ["doc", "ln"]).select("cls", F.round("ece", 6).alias("ece"))
    # a row a class, and two of points
    low, high = f.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY f1)")).first()[0], e.agg(F.min("ece")).first()[0]
    groups = e.count()
    k = f.withColumn("k", F.row_number().over(Window.orderBy("doc_class")))
    g = e.select("ece", F.row_number().over(Window.orderBy("cls")).alias("g"))
    now = k.join(g, F.col("g") == (F.col("k") - 1) % groups + 1).select(
        "doc_class", "f1", "ece", (F.col("f1") + F.when(F.col("k") % 2 == 0, 0.01).otherwise(0.004)).alias("base_f1"),
        F.when(F.col("k") % 3 == 0, F.col("ece") - 0.01).when(F.col("k") % 3 == 1, F.col("ece")).alias("base_ece"),
    )
    return calibrate.gate(now, low, high).select("doc_class", "low_f1", "high_ece", "f1_drop", "ece_rise", "passed")


# --- text, pointers, responses ---------------------------------------------------------


@query("SELECT event_id, '/rows/' || CASE WHEN event_id % 2 = 0 THEN '*' ELSE 'x' || event_id END || '/v' AS wild, CASE WHEN event_id % 2 = 0 THEN '*' ELSE 'x' || event_id END AS canon FROM events")
def q_pointers(spark: SparkSession, sf: str) -> DataFrame:
    token = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string")))
    p = F.concat(F.lit("/rows/"), token, F.lit("/v"))
    return table(spark, sf, "events").select("event_id", text.wildcard(p).alias("wild"), text.canonical_field(token).alias("canon"))


@query(r"SELECT conv_id, turn, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS form FROM conversations")
def q_token_forms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(text.token_form(F.col("text"))).alias("form"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS us, strftime(o_orderdate, '%Y-%m-%d') AS named,
  CASE WHEN floor(o_totalprice) = 0 THEN '0' ELSE '-' || CAST(floor(o_totalprice) AS BIGINT) END AS money FROM orders""")
def q_normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    d, o = F.col("o_orderdate"), table(spark, sf, "orders")
    return o.select(
        "o_orderkey", text.date_form(F.date_format(d, "yyyy-MM-dd")).alias("iso"), text.date_form(F.date_format(d, "M/d/yyyy")).alias("us"),
        text.date_form(F.date_format(d, "MMM d, yyyy")).alias("named"), text.currency_form(F.concat(F.lit("($ "), F.format_number(F.floor("o_totalprice"), 0), F.lit(".00)"))).alias("money"),
    )


@query("SELECT event_id, '/k' AS field, CAST(json_extract(props, '$.k') AS VARCHAR) AS value_json FROM events UNION ALL SELECT event_id, '/list/0', CAST(event_id % 5 AS VARCHAR) FROM events UNION ALL SELECT event_id, '/list/1/a~1b', 'null' FROM events")
def q_flatten(spark: SparkSession, sf: str) -> DataFrame:
    j = F.concat(F.lit('{"list": ['), (F.col("event_id") % 5).cast("string"), F.lit(', {"a/b": null, "none": []}], "empty": {}, '), F.substr("props", F.lit(2)))
    return adapters.flatten(table(spark, sf, "events").select("event_id", j.alias("j")), ["event_id"], "j")


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE replace(props, ' ', '') END AS repaired FROM events")
def q_json_repair(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("event_id") % 5, F.col("props")
    raw = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), p, F.lit(" Done.")))
        .when(k == 3, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(",}"))).otherwise(F.lit("no answer"))
    )
    return table(spark, sf, "events").select("event_id", text.repair_json(raw).alias("repaired"))


@query("""SELECT event_id, round(exp(CASE WHEN event_id % 3 = 0 THEN -0.1 ELSE (-0.1 - 0.3 - (event_id % 10) / 10.0) / 3 END), 6) AS confidence FROM events""")
def q_logprob_confidence(spark: SparkSession, sf: str) -> DataFrame:
    tok = lambda t, p: F.struct(F.lit(t).alias("token"), p.cast("double").alias("logprob"))
    tokens = F.array(tok("12", F.lit(-0.1)), tok(" x", F.lit(-0.3)), tok("{", -(F.col("event_id") % 10) / 10.0))
    value = F.when(F.col("event_id") % 3 == 0, F.lit("a 12")).otherwise(F.lit("zzz"))
    return table(spark, sf, "events").select("event_id", r6(text.logprob_confidence(tokens, value)).alias("confidence"))


@query("""SELECT event_id, CASE WHEN s IN (408, 425, 429) OR s >= 500 THEN 'transport_failure' WHEN s IN (401, 402, 403, 407) THEN 'fatal' WHEN s < 200 OR s >= 300 THEN 'contract_failure' END AS failure
FROM (SELECT event_id, [200, 204, 302, 400, 401, 403, 404, 408, 429, 500, 503][CAST(event_id % 11 + 1 AS BIGINT)] AS s FROM events)""")
def q_failure_kinds(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in (200, 204, 302, 400, 401, 403, 404, 408, 429, 500, 503)])
    calls = table(spark, sf, "events").select("event_id", F.get(codes, (F.col("event_id") % 11).cast("int")).alias("status"))
    return adapters.classify_calls(calls).select("event_id", "failure")


def _sweep_sql(label: str) -> str:
    return f"SELECT '{label}' AS label, count(*) AS n FROM documents WHERE regexp_matches(text, '{sinks.SWEEPS[label]}') HAVING count(*) > 0"


#: DuckDB's patterns have no look-ahead, so the one label that has one is not there; no document holds its literal part.
@query(" UNION ALL ".join(_sweep_sql(k) for k, p in sinks.SWEEPS.items() if "(?!" not in p))
def q_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.sweep_hits(table(spark, sf, "documents"), F.col("text")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name AS doc_class, n_name AS doc, sha256('salt:' || r_name || ':' || n_name) AS digest, n_nationkey % 3 = 0 AS known FROM nation JOIN region ON r_regionkey = n_regionkey""")
def q_salted_membership(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("doc_class"), F.col("n_name").alias("doc"), "n_nationkey")
    salt = F.lit("salt")
    ids = rows.filter("n_nationkey % 3 = 0").select(text.salted_digest(salt, F.col("doc_class"), F.col("doc")).alias("digest"))
    return values.salted_members(rows.drop("n_nationkey"), ids, salt)


@query("""SELECT event_id, 'https://h/v1/projects/<gcp-project>/' || user_id || '/projects/x' AS url, 'ray' || event_id AS ray FROM events""")
def q_redactions(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://h/v1/projects/p-"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit("/projects/x"))
    return table(spark, sf, "events").select("event_id", text.redact_url(url).alias("url"), text.redact_ray(F.concat(F.lit("ray"), F.col("event_id").cast("string"), F.lit("-FRA"))).alias("ray"))


@query("SELECT doc_id, md5(to_base64(encode(text))) AS b64, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def q_base64(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.md5(requests.base64_text(F.col("text").cast("binary"))).alias("b64"), F.sha2("text", 256).alias("digest"))


@query("""SELECT event_id, replace(replace(props, '~', '~0'), '/', '~1') AS escaped, props AS back, CASE WHEN event_id % 3 = 1 THEN 'invalid escape' WHEN event_id % 3 = 2 THEN 'does not start with /' END AS fault FROM events""")
def q_pointer_escapes(spark: SparkSession, sf: str) -> DataFrame:
    escaped, k = text.escape_token(F.col("props")), F.col("event_id") % 3
    p = F.when(k == 0, F.concat(F.lit("/"), escaped)).when(k == 1, F.lit("/a~2b")).otherwise(F.lit("a/b"))
    return table(spark, sf, "events").select("event_id", escaped.alias("escaped"), F.get(text.pointer_tokens(F.concat(F.lit("/"), escaped)), F.lit(0)).alias("back"), text.pointer_error(p).alias("fault"))


@query("""SELECT o_orderkey, '{"a/b":["' || CAST(floor(o_totalprice) AS BIGINT) || '",true,null],"n":{"k":"' || CAST(floor(o_totalprice) AS BIGINT) || '"}}' AS form FROM orders""")
def q_normal_containers(spark: SparkSession, sf: str) -> DataFrame:
    money = F.format_number(F.floor("o_totalprice"), 0)
    j = F.concat(F.lit('{"a/b":["$'), money, F.lit('.00",true,null],"n":{"k":" '), money, F.lit('"}}'))
    return table(spark, sf, "orders").select("o_orderkey", values.normal_container(F.lit("currency"), j).alias("form"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'requestId' WHEN event_id % 3 = 1 THEN 'modelVersion' END AS fault, CASE WHEN event_id % 3 <> 1 THEN 'm' || user_id END AS model FROM events""")
def q_provenance(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    model = F.when(k == 1, F.repeat(F.lit("x"), 201)).otherwise(F.concat(F.lit("m"), F.col("user_id").cast("string")))
    none = F.lit(None).cast("string")
    p = F.struct(model.alias("modelVersion"), none.alias("vendorVersion"), none.alias("calibratorVersion"), none.alias("apiVersion"), F.when(k == 0, F.lit("")).alias("requestId"))
    rows = table(spark, sf, "events").select("event_id", p.alias("p"))
    return rows.select("event_id", values.provenance_fault(F.col("p")).alias("fault"), values.clean_provenance(F.col("p"))["modelVersion"].alias("model"))


@query("SELECT cls, doc, ln, round(1 / (1 + exp(-(2.5 * confidence - 1))), 6) AS confidence FROM (WITH " + POINTS + " SELECT * FROM points)")
def q_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibrate.apply_platt(views.points(spark, sf), 2.5, -1.0).select("cls", "doc", "ln", "confidence"))


# --- responses of each kind, from events -----------------------------------------------

_RESPONSES = "SELECT event_id, '/n' AS field, CAST(user_id AS VARCHAR) AS value_json FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, '/t/0', '\"' || event_type || '\"' FROM events WHERE event_id % 7 <> 0"


def _mapped(spark: SparkSession, sf: str, kind: str, wrap) -> DataFrame:
    """Fields of responses that hold an answer, and one row with a null field for those that failed."""
    answer = F.concat(F.lit('{"n": '), F.col("user_id").cast("string"), F.lit(', "t": ["'), "event_type", F.lit('"]}'))
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit('{"other": 1}')).otherwise(wrap(answer)).alias("response"))
    return adapters.responses(kind, rows, ["event_id"]).select("event_id", "field", "value_json")


_FAILED = " UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 7 = 0"
_as_text = lambda a: F.replace(F.replace(a, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


@query(_RESPONSES + _FAILED)
def q_chat_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf, "chat", lambda a: F.concat(F.lit('{"choices": [{"message": {"content": "```json\\n'), _as_text(a), F.lit('\\n```"}}]}')))


@query(_RESPONSES + _FAILED)
def q_candidate_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf, "candidates", lambda a: F.concat(F.lit('{"candidates": [{"content": {"parts": [{"text": "Here: "}, {"text": "'), _as_text(a), F.lit('"}]}}]}')))


@query(_RESPONSES + _FAILED)
def q_annotation_fields(spark: SparkSession, sf: str) -> DataFrame:
    as_json = F.col("event_id") % 2 == 0
    return _mapped(spark, sf, "annotation", lambda a: F.concat(F.lit('{"document_annotation": '), F.when(as_json, a).otherwise(F.concat(F.lit('"'), _as_text(a), F.lit('"'))), F.lit("}")))


@query(_RESPONSES + _FAILED)
def q_job_fields(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("event_id") % 2 == 0, F.lit("data")).otherwise(F.lit("extract_result"))
    return _mapped(spark, sf, "job", lambda a: F.concat(F.lit('{"'), name, F.lit('": '), a, F.lit("}")))


@query("""SELECT event_id, '/n' AS field, CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END AS value_json, CASE WHEN event_id % 3 <> 0 THEN 0.25 END::DOUBLE AS confidence, false AS failed FROM events WHERE event_id % 3 <> 1 AND event_id % 7 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, true FROM events WHERE event_id % 7 = 0""")
def q_stated_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    n = F.when(k == 0, F.lit('{"state": "null"}')).when(k == 1, F.lit('{"state": "missing"}')).otherwise(F.concat(F.lit('{"state": "present", "confidence": 0.25, "value": '), F.col("user_id").cast("string"), F.lit("}")))
    bad = F.lit('{"fields": {"/n": {"state": "present"}}}')
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, bad).otherwise(F.concat(F.lit('{"fields": {"/n": '), n, F.lit("}}"))).alias("response"))
    fields, failed = adapters.get_adapter("stated")(rows, ["event_id"])
    none = F.lit(None)
    lost = failed.select("event_id", none.cast("string").alias("field"), none.cast("string").alias("value_json"), none.cast("double").alias("confidence"), F.lit(True).alias("failed"))
    return fields.withColumn("failed", F.lit(False)).unionByName(lost)


@query("""SELECT event_id FROM events WHERE event_id % 4 <> 0""")
def q_stamp_violations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    stamp = F.when(k == 0, F.lit("cal-2026.05-1")).when(k == 1, F.lit("cal-2026.5")).when(k == 2, F.lit("cal-2026.05-2"))
    rows = table(spark, sf, "events").select("event_id", F.struct(stamp.alias("calibratorVersion")).alias("provenance"))
    return adapters.stamp_violations(rows, "cal-2026.05-1").select("event_id")


#: Fields are the first words of benchmark items, single and in pairs, in the two languages that have most texts.
@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
f AS (SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS doc_class, unnest([w[1] || '_' || w[2], w[3], w[4]]) AS field FROM w),
t AS (SELECT *, CASE WHEN replace(field, '_', ' ') = field THEN [field] ELSE [field, trim(replace(field, '_', ' '))] END AS tokens FROM f WHERE field IS NOT NULL)
SELECT doc_class, doc, field, tokens[list_position(found, true)] AS token FROM (
  SELECT t.doc_class, d.doc_id AS doc, field, tokens, list_transform(tokens, lambda x: contains(lower(d.text), lower(x))) AS found
  FROM documents d JOIN t ON t.doc_class = d.lang WHERE d.text IS NOT NULL) WHERE list_contains(found, true)""")
def q_text_hits(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("lang").alias("doc_class"), F.col("doc_id").alias("doc"), "text")
    w = F.split("text", " ")
    names = F.array(F.concat(F.get(w, F.lit(0)), F.lit("_"), F.get(w, F.lit(1))), F.get(w, F.lit(2)), F.get(w, F.lit(3)))
    fields = table(spark, sf, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr").alias("doc_class"), F.explode(names).alias("field")).filter("field is not null")
    return probes.text_hits(texts, fields)


# --- probes, corpora, dataset ----------------------------------------------------------

_FIELDS = "fields AS (SELECT DISTINCT event_type AS doc_class, 'f' || user_id || '_' || (event_id % 7) AS field FROM events)"


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("doc_class"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit("_"), (F.col("event_id") % 7).cast("string")).alias("field"), F.lit(True).alias("leaf")).distinct()


@query(f"""WITH {_FIELDS}, pool AS (SELECT c.doc_class, f.field, min(f.doc_class) AS source_class FROM (SELECT DISTINCT doc_class FROM fields) c JOIN fields f ON f.doc_class <> c.doc_class
  WHERE NOT EXISTS (SELECT 1 FROM fields o WHERE o.doc_class = c.doc_class AND o.field = f.field) GROUP BY 1, 2)
SELECT doc_class, field, source_class, CAST(row_number() OVER (PARTITION BY doc_class ORDER BY source_class, field) - 1 AS INTEGER) AS at FROM pool""")
def q_probe_pool(spark: SparkSession, sf: str) -> DataFrame:
    return probes.pools(_fields(spark, sf))


@query(f"WITH {CELLS}, p AS (SELECT DISTINCT doc_class, unnest(['/extra_a', '/extra_b']) AS field FROM goldens) SELECT d.doc_class, d.doc, p.field, 'missing' AS state FROM (SELECT DISTINCT doc_class, doc FROM goldens) d JOIN p USING (doc_class)")
def q_probe_goldens(spark: SparkSession, sf: str) -> DataFrame:
    g = views.goldens(spark, sf)
    p = g.select("doc_class").distinct().withColumn("field", F.explode(F.array(F.lit("extra_a"), F.lit("extra_b"))))
    return probes.probe_goldens(g, p).drop("value_json")


_SHEET = "sheet AS (SELECT event_type AS doc_class, 'f' || (event_id % 11) AS field, event_id AS line, CAST(user_id AS VARCHAR) AS doc, event_id % 3 = 0 AS visible FROM events)"


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("doc_class"), F.concat(F.lit("f"), (F.col("event_id") % 11).cast("string")).alias("field"), F.col("event_id").alias("line"), F.col("user_id").cast("string").alias("doc"), (F.col("event_id") % 3 == 0).alias("visible"))


@query(f"WITH {_SHEET} SELECT doc_class, field, string_agg(doc, ',' ORDER BY line) AS documents FROM sheet WHERE visible GROUP BY 1, 2")
def q_strikes(spark: SparkSession, sf: str) -> DataFrame:
    return probes.strikes(_sheet(spark, sf)).select("doc_class", "field", F.array_join("documents", ",").alias("documents"))


_STRUCK = _SHEET + ", p AS (SELECT DISTINCT doc_class, field FROM sheet), s AS (SELECT DISTINCT doc_class, field FROM sheet WHERE field IN ('f1', 'f7'))"


def _probes_and_strikes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = _sheet(spark, sf).select("doc_class", "field").distinct()
    return p, p.filter(F.col("field").isin("f1", "f7"))


@query(f"WITH {_STRUCK} SELECT doc_class, field FROM p ANTI JOIN s USING (doc_class, field)")
def q_remaining_probes(spark: SparkSession, sf: str) -> DataFrame:
    return probes.struck_probes(*_probes_and_strikes(spark, sf))


@query(f"WITH {_STRUCK} SELECT doc_class, field, s.field IS NOT NULL AS struck FROM p LEFT JOIN s USING (doc_class, field)".replace("s.field IS NOT NULL", "(doc_class, field) IN (SELECT (doc_class, field) FROM s)").replace(" LEFT JOIN s USING (doc_class, field)", ""))
def q_probe_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.probe_rows(*_probes_and_strikes(spark, sf))


_PAGES = "pages_ AS (SELECT DISTINCT doc_class, doc, doc % 12 + 1 AS pages FROM goldens)"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return views.goldens(spark, sf).select("doc_class", "doc").distinct().withColumn("pages", F.col("doc") % 12 + 1)


@query(f"""WITH {CELLS}, {_PAGES}, d AS (SELECT doc_class, doc, any_value(pages) AS pages, count(*) AS fields, count(*) FILTER (state = 'missing') AS absent FROM goldens JOIN pages_ USING (doc_class, doc) GROUP BY 1, 2)
SELECT doc_class, count(*) AS docs, count(*) FILTER (pages <= 8) AS docs_within_cap, sum(fields)::BIGINT AS fields, sum(absent)::BIGINT AS absent, sum(pages)::BIGINT AS pages,
  sum(fields) FILTER (pages <= 8)::BIGINT AS fields_within_cap, sum(absent) FILTER (pages <= 8)::BIGINT AS absent_within_cap, sum(pages) FILTER (pages <= 8)::BIGINT AS pages_within_cap
FROM d GROUP BY GROUPING SETS ((), (doc_class))""")
def q_corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.corpus_counts(views.goldens(spark, sf), _pages(spark, sf))


#: A split made from orders, with each kind of fault at its own orders: files, source and frozen goldens, manifests.
_SPLIT = """o AS (SELECT o_orderstatus AS c, o_orderkey AS k, (o_orderkey % 3000)::INT AS m, o_custkey AS cust FROM orders),
files AS (SELECT c AS doc_class, k || '.pdf' AS doc, CASE WHEN m % 101 = 7 THEN NULL ELSE k % 13 END AS pages FROM o WHERE m % 97 <> 5),
source AS (SELECT c AS doc_class, CASE WHEN m % 89 = 3 THEN k || '.PDF' ELSE k::VARCHAR END AS doc, CASE WHEN m % 83 = 2 THEN 'Z' ELSE c END AS row_class, cust::VARCHAR AS cells, k, m FROM o WHERE m % 79 <> 11),
sources AS (SELECT doc_class, doc, row_class, cells FROM source UNION ALL SELECT doc_class, k::VARCHAR, doc_class, 'again' FROM source WHERE m % 73 = 1),
frozen AS (SELECT c AS doc_class, k || CASE WHEN k % 2 = 0 THEN '.pdf' ELSE '' END AS doc, c AS row_class, CASE WHEN m % 71 = 9 THEN 'other' ELSE cust::VARCHAR END AS cells FROM o WHERE m % 67 <> 8),
named AS (SELECT *, CASE WHEN lower(doc) LIKE '%.pdf' THEN doc ELSE doc || '.pdf' END AS file FROM sources),
s AS (SELECT doc_class, file AS doc, count(*) AS n, max((row_class, cells)) AS g, bool_or(lower(doc) LIKE '%.pdf') AS suffixed, bool_or(row_class <> doc_class) AS strange FROM named GROUP BY 1, 2),
f AS (SELECT doc_class, CASE WHEN doc LIKE '%.pdf' THEN doc ELSE doc || '.pdf' END AS doc, count(*) AS n, max((row_class, cells)) AS g FROM frozen GROUP BY 1, 2),
every AS (SELECT doc_class, doc, pages, d.doc_class IS NOT NULL AS there, coalesce(s.n, 0) AS sn, coalesce(f.n, 0) AS fn, s.g AS sg, f.g AS fg, suffixed, strange
  FROM (SELECT *, doc_class AS dc FROM files) d FULL JOIN s USING (doc_class, doc) FULL JOIN f USING (doc_class, doc))"""


@query(f"""WITH {_SPLIT.replace("d.doc_class IS NOT NULL", "dc IS NOT NULL")}
SELECT doc_class, doc, unnest(list_filter([CASE WHEN strange THEN 'source row of another class' END, CASE WHEN suffixed THEN 'source row names a file' END, CASE WHEN sn > 1 THEN 'more than one source row' END,
  CASE WHEN fn > 1 THEN 'more than one frozen row' END, CASE WHEN there AND sn = 0 THEN 'document without a source row' END, CASE WHEN there AND fn = 0 THEN 'document without a frozen row' END,
  CASE WHEN NOT there AND fn > 0 THEN 'frozen row without a document' END, CASE WHEN there AND sn = 1 AND fn = 1 AND sg <> fg THEN 'source and frozen rows differ' END,
  CASE WHEN there AND coalesce(pages, 0) < 1 THEN 'no page count' END], lambda x: x IS NOT NULL)) AS fault FROM every
UNION ALL SELECT c, NULL, 'frozen goldens aren''t those of the manifest' FROM (SELECT DISTINCT c FROM o) WHERE c = 'F' UNION ALL SELECT c, NULL, 'manifest without the class and its hash' FROM (SELECT DISTINCT c FROM o) WHERE c = 'P'""")
def q_corpus_faults(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("doc_class"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3000).alias("m"), F.col("o_custkey").cast("string").alias("cust"))
    key, m = F.col("k").cast("string"), F.col("m")
    files = o.filter(m % 97 != 5).select("doc_class", F.concat(key, F.lit(".pdf")).alias("doc"), F.when(m % 101 != 7, F.col("k") % 13).alias("pages"))
    source = o.filter(m % 79 != 11)
    own = source.select("doc_class", F.when(m % 89 == 3, F.concat(key, F.lit(".PDF"))).otherwise(key).alias("doc"), F.when(m % 83 == 2, "Z").otherwise(F.col("doc_class")).alias("row_class"), F.col("cust").alias("cells"))
    twice = source.filter(m % 73 == 1).select("doc_class", key.alias("doc"), F.col("doc_class").alias("row_class"), F.lit("again").alias("cells"))
    frozen = o.filter(m % 67 != 8).select("doc_class", F.concat(key, F.when(F.col("k") % 2 == 0, ".pdf").otherwise("")).alias("doc"), F.col("doc_class").alias("row_class"), F.when(m % 71 == 9, "other").otherwise(F.col("cust")).alias("cells"))
    classes = o.select("doc_class").distinct()
    manifests = classes.select("doc_class", F.when(F.col("doc_class") != "P", F.col("doc_class")).alias("named"), F.sha2("doc_class", 256).alias("expected"))
    hashes = classes.select("doc_class", F.sha2(F.when(F.col("doc_class") == "F", "changed").otherwise(F.col("doc_class")), 256).alias("sha256"))
    built = corpora.build_rows(files, own.unionByName(twice), frozen)
    return corpora.document_faults(built).unionByName(corpora.class_faults(classes, files, manifests, hashes))


@query(f"WITH {CELLS}, {_PAGES} SELECT doc_class, pages, count(*) AS docs FROM pages_ GROUP BY 1, 2")
def q_page_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.page_histogram(_pages(spark, sf))


@query(f"WITH {CELLS} SELECT doc_class, doc, field, state FROM goldens WHERE doc % 12 + 1 <= 8")
def q_capped_goldens(spark: SparkSession, sf: str) -> DataFrame:
    out = adapters.over_cap(_pages(spark, sf))
    return matrix.capped_goldens(views.goldens(spark, sf), out).select("doc_class", "doc", "field", "state")


_ROWS = JUDGED + """, published AS (
  SELECT v.doc_class, v.doc, v.repeat, v.field, v.state AS gold_state, v.availability,
    CASE WHEN NOT usable THEN 'failed' WHEN NOT found THEN 'omitted' WHEN value_json = 'null' THEN 'null' WHEN headline = 1 THEN 'value' ELSE 'declined' END AS predicted_state,
    CASE WHEN found THEN value_json END AS value, round(confidence, 6) AS confidence, s.field IS NOT NULL AND v.state <> 'present' AS struck,
    CASE WHEN v.state <> 'present' AND s.field IS NULL AND usable THEN headline = 1 END AS fabricated, CASE WHEN v.state <> 'present' AND s.field IS NULL AND usable THEN strict = 1 END AS fabricated_strict
  FROM verdicts v LEFT JOIN strikes s USING (doc_class, doc, field))"""


@query(f"WITH {_ROWS} SELECT 'a1' AS arm, 'main' AS pass, * FROM published")
def q_dataset_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dataset.prediction_rows(_judged(spark, sf), views.strikes(spark, sf), "a1", "main"))


@query(f"WITH {_ROWS} SELECT 'a1' AS arm, 'main' AS pass, doc_class, count(*) AS rows, count(fabricated) AS judged, count(*) FILTER (fabricated) AS fabricated FROM published GROUP BY doc_class")
def q_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.summary(dataset.prediction_rows(_judged(spark, sf), views.strikes(spark, sf), "a1", "main"))


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, o_orderkey || ' ' || o_orderstatus || '/' || o_custkey AS line FROM orders),
h AS (SELECT r, sha256(r || chr(10) || line) AS h FROM l),
w AS (SELECT r // 1000 AS range, unnest([0, 1, 2, 3]) AS i, ('0x' || unnest([h[1:16], h[17:32], h[33:48], h[49:64]]))::UBIGINT AS x FROM h),
x AS (SELECT range, i, count(*) AS lines, bit_xor(x) AS x FROM w GROUP BY 1, 2)
SELECT range, any_value(lines) AS lines, string_agg(lpad(lower(to_hex(x)), 16, '0'), '' ORDER BY i) AS digest FROM x GROUP BY 1""")
def q_dataset_digest(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderstatus"), F.lit("/"), F.col("o_custkey").cast("string"))
    return digest.range_digests(table(spark, sf, "orders").select("o_orderkey", line.alias("value")), ["o_orderkey"], size=1000)


@query(f"WITH {CELLS} SELECT g.doc_class, g.doc, g.field, g.state, coalesce(s.reason, 'confirmed') AS verdict FROM goldens g LEFT JOIN strikes s USING (doc_class, doc, field) WHERE g.state <> 'present'")
def q_audit(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.audit_rows(views.goldens(spark, sf), views.strikes(spark, sf))


#: Of letters alone, collation goes by letters first, then small before capital ones.
_NAMED = """n AS (SELECT c_mktsegment AS doc_class, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name ELSE n_name[1] || lower(n_name[2:]) END AS field, min(c_custkey) AS doc
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT contains(n_name, ' ') GROUP BY 1, 2)"""


@query(f"""WITH {_NAMED} SELECT doc_class, field, row_number() OVER (ORDER BY lower(doc_class), lower(field), translate(field, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')) - 1 AS place FROM n""")
def q_strike_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).filter(~F.contains("n_name", F.lit(" ")))
    k = F.col("c_custkey") % 3
    field = F.when(k == 0, F.lower("n_name")).when(k == 1, F.col("n_name")).otherwise(F.concat(F.substring("n_name", 1, 1), F.lower(F.substr("n_name", F.lit(2)))))
    sheet = rows.select(F.col("c_mktsegment").alias("doc_class"), field.alias("field"), F.col("c_custkey").cast("string").alias("doc"), F.col("c_custkey").alias("line"), F.lit(True).alias("visible"))
    return probes.in_order(probes.strikes(sheet), "place").select("doc_class", "field", "place")


#: A sound form tells nothing apart that was equal; one that also looks at the order's customer does.
@query("""WITH f AS (SELECT o_orderpriority AS before, lower(trim(o_orderpriority)) AS sound, CASE WHEN o_custkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS broken FROM orders),
b AS (SELECT 'sound' AS form, before, sound AS after FROM f UNION ALL SELECT 'broken', before, broken FROM f)
SELECT form, '"' || before || '"' AS before, '"' || min(after) || '"' AS one, '"' || max(after) || '"' AS other FROM b GROUP BY form, before HAVING min(after) <> max(after)""")
def q_monotone_faults(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    before = quoted(F.col("o_orderpriority")).alias("before")
    sound = o.select(F.lit("sound").alias("form"), before, quoted(text.normal_form(F.lit("text"), F.col("o_orderpriority"))).alias("after"))
    broken = o.select(F.lit("broken").alias("form"), before, quoted(F.when(F.col("o_custkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))).alias("after"))
    return cells.monotone_faults(sound.unionByName(broken), ["form"])


# --- run log ---------------------------------------------------------------------------


@query(f"""WITH {CELLS}, i AS (SELECT *, sum(CAST(availability <> 'contract_failure' AS INTEGER)) OVER (PARTITION BY doc_class ORDER BY doc, repeat) AS isle FROM records)
SELECT doc_class, doc, repeat, CAST(sum(CAST(availability = 'contract_failure' AS INTEGER)) OVER (PARTITION BY doc_class, isle ORDER BY doc, repeat) AS BIGINT) AS streak FROM i""")
def q_failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.streaks(views.records(spark, sf), ["doc_class"], ["doc", "repeat"]).select("doc_class", "doc", "repeat", "streak")


@query(f"""WITH {CELLS}, l AS (SELECT doc_class, max(doc * 10 + repeat) FILTER (availability <> 'contract_failure') AS last FROM records GROUP BY 1)
SELECT doc_class, count(*) FILTER (last IS NULL OR doc * 10 + repeat > last) AS trailing FROM records JOIN l USING (doc_class) GROUP BY 1""")
def q_trailing_failures(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.trailing_streak(views.records(spark, sf), ["doc_class"], ["doc", "repeat"])


@query("""SELECT event_type AS arm, array_to_string(list_sort(list(DISTINCT v) FILTER (v IS NOT NULL)), ',') AS vals, count(*) FILTER (v IS NULL) AS missing,
  CASE WHEN count(DISTINCT v) = 0 THEN 'not_surfaced' WHEN count(DISTINCT v) = 1 AND count(*) FILTER (v IS NULL) = 0 THEN 'surfaced' ELSE 'mixed' END AS status
FROM (SELECT event_type, CASE WHEN event_type = 'click' THEN 'v1' WHEN event_type = 'error' THEN NULL WHEN event_id % 3 > 0 THEN 'v' || (event_id % 3) END AS v FROM events) GROUP BY 1""")
def q_observed_versions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_type") == "click", "v1").when(F.col("event_type") == "error", None).when(F.col("event_id") % 3 > 0, F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")))
    out = runlog.observed(table(spark, sf, "events").withColumn("arm", F.col("event_type")), ["arm"], v)
    return out.select("arm", F.nullif(F.array_join("values", ","), F.lit("")).alias("vals"), "missing", "status")


@query(f"WITH {CELLS} SELECT doc_class, doc, repeat FROM (SELECT DISTINCT doc_class, doc FROM goldens) CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS repeat) WHERE (doc_class, doc, repeat) NOT IN (SELECT (doc_class, doc, repeat) FROM records WHERE availability = 'completed')")
def q_pending_units(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoint.pending(views.goldens(spark, sf).select("doc_class", "doc").distinct(), 3, views.records(spark, sf).filter("availability = 'completed'"))


@query("""WITH c AS (SELECT n_name AS cell, n_nationkey AS k FROM nation)
SELECT c.cell, CASE WHEN k % 2 = 0 THEN k END AS started, CASE WHEN k % 3 = 0 THEN k * 2 END AS spend, CASE WHEN k % 5 = 0 THEN 'complete' END AS status FROM c""")
def q_cost_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("cell"), F.col("n_nationkey").alias("k"))
    meta, manifest = n.filter("k % 2 = 0").select("cell", F.col("k").alias("started")), n.filter("k % 3 = 0").select("cell", (F.col("k") * 2).alias("spend"))
    return runlog.costs(n.select("cell"), meta, manifest, n.filter("k % 5 = 0").select("cell", F.lit("complete").alias("status")))


@query("SELECT n_name AS cell, unnest(list_filter([CASE WHEN n_nationkey % 2 = 0 THEN 'startedAt' END, CASE WHEN n_nationkey % 3 = 0 THEN 'spend' END], lambda x: x IS NOT NULL)) AS missing FROM nation")
def q_publication_gaps(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    meta = n.select(F.col("n_name").alias("cell"), F.when(F.col("n_nationkey") % 2 != 0, "t").alias("startedAt"), F.when(F.col("n_nationkey") % 3 != 0, 1.0).alias("spend"))
    return runlog.publication_gaps(meta, ("startedAt", "spend"))


@query("""SELECT 'incomplete: ' || n_name AS problem FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT n_name || ' lacks spend' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT '2 commits'""")
def q_publication_problems(spark: SparkSession, sf: str) -> DataFrame:
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    cells_ = n.select(F.col("n_name").alias("cell"), F.when(k % 6 == 0, "paused").otherwise("complete").alias("status"), F.when(k % 2 == 0, "c1").otherwise("c2").alias("commit"))
    meta = n.select(F.col("n_name").alias("cell"), F.when(k % 5 != 0, 1.0).alias("spend"))
    return runlog.publication_problems(cells_, runlog.publication_gaps(meta, ("spend",)))


@query("""WITH arms AS (SELECT * FROM (VALUES ('a1', 'stated', 0.02::DOUBLE), ('a4', 'annotation', 0.005::DOUBLE)) t(arm, adapter, usd)), passes AS (SELECT unnest(['main', 'probe']) AS pass),
docs AS (SELECT DISTINCT r_name AS doc_class, n_nationkey AS doc FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT arm, doc_class, pass, CASE WHEN pass = 'probe' THEN 1 ELSE 3 END AS repeats, count(*) AS docs, count(*) FILTER (NOT (adapter = 'annotation' AND doc % 7 = 0)) AS run_docs,
  round(any_value(usd) * count(*) FILTER (NOT (adapter = 'annotation' AND doc % 7 = 0)) * CASE WHEN pass = 'probe' THEN 1 ELSE 3 END, 6) AS expected_usd
FROM arms CROSS JOIN passes CROSS JOIN docs GROUP BY arm, adapter, doc_class, pass""")
def q_matrix_cells(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("doc_class"), F.col("n_nationkey").alias("doc"))
    names = sorted(r[0] for r in d.select("doc_class").distinct().collect())  # five classes
    out = tuple((r.doc_class, str(r.doc)) for r in d.filter("doc % 7 = 0").collect())
    m = matrix.Matrix((matrix.Arm("a1", "stated", 0.02), matrix.Arm("a4", "annotation", 0.005)), tuple(names), cap_branch="cap-confirmed", excluded=out)
    docs = d.withColumn("doc", F.col("doc").cast("string")).withColumn("pass", F.explode(F.array(F.lit("main"), F.lit("probe"))))
    return rounded(matrix.cells(spark, m, docs).select("arm", "doc_class", "pass", "repeats", "docs", "run_docs", "expected_usd"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'not_an_object' WHEN event_id % 4 = 1 THEN 'no_value_key' WHEN event_id % 101 > 100 - 1 THEN 'invalid_confidence' END AS violation FROM events".replace("event_id % 101 > 100 - 1", "value > 100"))
def q_field_violations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    return table(spark, sf, "events").select("event_id", values.field_violation(k != 0, k != 1, F.lit(True), F.when(F.col("value") > 100, 2.0).otherwise(0.5)).alias("violation"))
