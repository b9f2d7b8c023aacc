"""Seeded document-clustered bootstrap with BCa intervals of additive statistics, families of contrasts, and Holm's correction.

A resample draws clusters with replacement within strata.  Draw number b N + i of the seed's stream is what a sequential loop would
use, so any resample can be drawn alone.  A statistic is a closing function of sums over the drawn clusters (totals and counts,
tp, fp and fn, one pair of columns a contrast), so a cluster is a short vector, a resample the sum of N of them, and a
jackknife value the closing function of all sums less the cluster's own.

Clusters are packed into blocks of bounded bytes.  Each block goes to each part of the resamples; such a task makes the draws of its resamples
with numpy and adds up those that fall into its block.  What is shuffled are the blocks, once a part, and a row a resample
and block; draws are not.  Draws are made once a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import Rng, normal_cdf, normal_quantile, quantile, uniforms
from .cells import scores
from .order import numbered_rows, settled

RESAMPLES = 10_000
SEED = 20260712
#: Bytes of a block of clusters, and draws that a task makes at once.
BLOCK_BYTES, DRAWS = 16 << 20, 1 << 20
Sums = Callable[[str], Column]


@dataclass(frozen=True)
class Interval:
    estimate: float
    lo: float
    hi: float
    level: float
    resamples: int
    method: str
    p_zero: float


def numbered(clusters: DataFrame, order: list[str], stratum: str | None = None) -> DataFrame:
    """Adds ``stratum_no``, ``at`` (place in the stratum), ``size`` and ``offset`` (clusters of all strata before), in the order of ``order``.

    Clusters are documents' sums: one row a document.
    """
    whole = clusters.select(F.struct(*clusters.columns).alias("row"), (F.col(stratum) if stratum else F.lit(0)).alias("stratum"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    rows = numbered_rows(whole, ["stratum"], [f"_o{i}" for i in range(len(order))])
    # strata differ in the clusters before them
    return rows.select("row.*", F.col("before").alias("stratum_no"), F.col("r").alias("at"), F.col("n").alias("size"), F.col("before").alias("offset"))


def _packed(placed: DataFrame, columns: list[str], size: int) -> DataFrame:
    """``block, low, data``: the vectors of ``size`` clusters in a row, in the order of their places."""

    def pack(table: pa.Table) -> pa.Table:
        place = table.column("place").to_numpy()
        low = int(place[0]) // size * size
        data = np.zeros((int(place.max()) - low + 1, len(columns)))
        for j, c in enumerate(columns):
            data[place - low, j] = table.column(c).to_numpy()
        return pa.table({"block": pa.array([low // size], pa.int64()), "low": pa.array([low], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    place = (F.col("stratum_no") + F.col("at")).alias("place")
    rows = placed.select(place, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.groupBy(F.floor(F.col("place") / size).alias("_block")).applyInArrow(pack, "block long, low long, data binary")


def resample_vectors(spark: SparkSession, placed: DataFrame, columns: list[str], seed: int = SEED, resamples: int = RESAMPLES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``b`` and the sums of ``columns`` over each resample of numbered clusters (``stratum_no, at, size`` beside them).

    Whole numbers keep their type; they are added as doubles, exactly below 2^53.
    """
    count = placed.count()
    # a row a stratum: classes
    strata = [(r.stratum_no, r.size) for r in placed.select("stratum_no", "size").distinct().orderBy("stratum_no").collect()]
    size = max(1, block_bytes // (8 * len(columns)))
    blocks = max(1, -(-count // size))
    parts = max(1, min(resamples, -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    per = -(-resamples // parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"]).reshape(-1, len(columns))
                low, high = row["low"], row["low"] + len(data)
                own = range(row["part"] * per, min(resamples, (row["part"] + 1) * per))
                out = np.zeros((len(own), len(columns)))
                for j, b in enumerate(own):
                    for before, n in strata:
                        if before + n <= low or before >= high:
                            continue  # no draw of this stratum can fall into the block
                        for at in range(0, n, DRAWS):
                            first = b * count + before + at
                            u = uniforms(seed, np.arange(first, first + min(DRAWS, n - at)))
                            place = before + np.floor(u * n).astype(np.int64)
                            if before < low or before + n > high:
                                place = place[(place >= low) & (place < high)]
                            times = np.bincount(place - low, minlength=len(data))
                            out[j] += times @ data
                yield pa.RecordBatch.from_arrays([pa.array(np.array(own, dtype=np.int64)), *(pa.array(x) for x in out.T)], names=["b", *columns])

    each = _packed(placed, columns, size).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sums = each.repartition(min(blocks * parts, 100_000), "block", "part").mapInArrow(add, "b long, " + ", ".join(f"`{c}` double" for c in columns))
    kinds = dict(placed.dtypes)
    whole = lambda c: F.round(F.sum(c)).cast("long") if kinds[c] in ("tinyint", "smallint", "int", "bigint") else F.sum(c)
    return sums.groupBy("b").agg(*[whole(c).alias(c) for c in columns])


def resample_sums(spark: SparkSession, clusters: DataFrame, seed: int = SEED, resamples: int = RESAMPLES) -> DataFrame:
    """``b, total, n`` of each resample of numbered clusters."""
    return resample_vectors(spark, clusters, ["total", "n"], seed, resamples)


def _acceleration(jack: list[float]) -> float:
    if len(jack) < 2:
        return 0.0
    mean = math.fsum(jack) / len(jack)
    square = math.fsum((mean - v) ** 2 for v in jack)
    return math.fsum((mean - v) ** 3 for v in jack) / (6 * square**1.5) if square > 0 else 0.0


def _below(estimate: float, boot: list[float]) -> float:
    return (sum(v < estimate for v in boot) + sum(v == estimate for v in boot) / 2) / len(boot)


def _bca(estimate: float, boot: list[float], a: float, level: float) -> Interval:
    b = len(boot)
    le, ge = sum(v <= 0 for v in boot), sum(v >= 0 for v in boot)
    p_zero = min(1.0, 2 * min((1 + le) / (b + 1), (1 + ge) / (b + 1)))
    if min(boot) == max(boot):
        return Interval(estimate, estimate, estimate, level, b, "degenerate", p_zero)
    z0 = normal_quantile(min(1 - 1 / (b + 1), max(1 / (b + 1), _below(estimate, boot))))
    ends = []
    for tail in ((1 - level) / 2, 1 - (1 - level) / 2):
        z = z0 + normal_quantile(tail)
        ends.append(quantile(boot, min(1.0, max(0.0, normal_cdf(z0 + z / (1 - a * z))))))
    return Interval(estimate, min(ends), max(ends), level, b, "bca", p_zero)


def pooled_mean(sums: Sums) -> Column:
    return F.try_divide(sums("total"), sums("n").cast("double"))


def pooled_f1(sums: Sums) -> Column:
    """F1 of pooled cells, with the conventions of ``cells.scores``."""
    return scores(sums("tp"), sums("fp"), sums("fn"))[2]


def by_class(clusters: DataFrame, classes: list[str], columns: list[str]) -> tuple[DataFrame, list[str]]:
    """``columns`` of each class as columns of their own (0 in other classes), and their names; classes are few."""
    own = {f"{c}{i}": F.when(F.col("doc_class") == k, F.col(c)).otherwise(F.lit(0)) for i, k in enumerate(classes) for c in columns}
    return clusters.withColumns(own), list(own)


def macro_f1(classes: int) -> Callable[[Sums], Column]:
    """Equal-weight mean of the classes' pooled F1, over the columns that ``by_class`` makes of tp, fp and fn."""

    def close(sums: Sums) -> Column:
        each = [pooled_f1(lambda c, i=i: sums(f"{c}{i}")) for i in range(classes)]
        return sum(each[1:], each[0]) / classes

    return close


def f1_delta(sums: Sums) -> Column:
    """Pooled F1 of arm a less that of arm b, from the cells of both (``a_tp`` ... ``b_fn``)."""
    return pooled_f1(lambda c: sums(f"a_{c}")) - pooled_f1(lambda c: sums(f"b_{c}"))


@dataclass(frozen=True)
class Resampled:
    """What intervals of a statistic are made of: one number a resample, and the jackknife's acceleration."""

    estimate: float
    boot: list[float]
    acceleration: float

    def interval(self, level: float = 0.95) -> Interval:
        return _bca(self.estimate, self.boot, self.acceleration, level)


def resampled(spark: SparkSession, clusters: DataFrame, columns: list[str], closings: dict[str, Callable[[Sums], Column]], order: list[str],
              stratum: str | None = None, seed: int = SEED, resamples: int = RESAMPLES) -> dict[str, Resampled]:
    """Each statistic of ``closings`` over the same resamples of ``clusters`` (one row each, with ``columns``); none without clusters.

    What reaches the driver is a number a resample and statistic, and the jackknife's moments.  A statistic that a resample, or leaving out
    a cluster, leaves undefined (null) is left out there.  ``order`` numbers the clusters, so it must tell them apart.
    """
    if not resamples > 0:
        raise ValueError("resamples must be positive")
    placed = settled(numbered(clusters, order, stratum).select("stratum_no", "at", "size", *columns))
    whole = placed.agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n")).first()
    if not whole["_n"]:
        return {}
    one = placed.agg(*[F.sum(c).alias(c) for c in columns]).select(*[close(F.col).cast("double").alias(name) for name, close in closings.items()]).first()
    drawn = resample_vectors(spark, placed, columns, seed, resamples)
    rows = drawn.select(*[close(F.col).cast("double").alias(name) for name, close in closings.items()]).collect()
    moments: dict[str, float] = dict.fromkeys(closings, 0.0)
    if whole["_n"] > 1:
        # two passes over the clusters: means, then second and third moments about them
        rest = lambda c: F.lit(whole[c]) - F.col(c)
        jack = placed.select(*[close(rest).cast("double").alias(name) for name, close in closings.items()])
        mean = jack.agg(*[F.avg(name).alias(name) for name in closings]).first()
        away = jack.select(*[(F.lit(mean[name]) - F.col(name)).alias(name) for name in closings])
        powers = away.agg(*[F.sum(F.col(name) ** k).alias(f"{name}_{k}") for name in closings for k in (2, 3)]).first()
        for name in closings:
            square, cube = powers[f"{name}_2"], powers[f"{name}_3"]
            moments[name] = cube / (6 * square**1.5) if square and square > 0 else 0.0
    return {name: Resampled(one[name], [r[name] for r in rows if r[name] is not None], moments[name]) for name in closings}


def interval(spark: SparkSession, clusters: DataFrame, columns: list[str], closing: Callable[[Sums], Column], order: list[str],
             stratum: str | None = None, seed: int = SEED, resamples: int = RESAMPLES, level: float = 0.95) -> Interval | None:
    """BCa interval of one additive statistic; null without clusters."""
    if not 0 < level < 1:
        raise ValueError("the level must be in (0, 1)")
    found = resampled(spark, clusters, columns, {"value": closing}, order, stratum, seed, resamples)
    return found["value"].interval(level) if found else None


def pooled_interval(spark: SparkSession, clusters: DataFrame, order: list[str], stratum: str | None = None,
                    seed: int = SEED, resamples: int = RESAMPLES, level: float = 0.95) -> Interval | None:
    """BCa interval of sum(total) / sum(n) over document clusters that hold a cell; null without any."""
    return interval(spark, clusters.filter("n > 0"), ["total", "n"], pooled_mean, order, stratum, seed, resamples, level)


def contrasts(spark: SparkSession, values: DataFrame, baseline: str, value: str = "value", stratum: str | None = None, seed: int = SEED,
              resamples: int = RESAMPLES, alpha: float = 0.05, level: float = 0.95) -> DataFrame:
    """A family of paired contrasts: each arm's mean difference to the baseline over documents, with Holm's correction over the family.

    ``values``: ``arm, doc_class, doc`` and a number, one row each.  All contrasts see the same draws of the baseline's documents; a document that
    an arm lacks counts in no mean of that arm.  Gives ``contrast, docs, estimate, lo, hi, method, acceleration, below`` (share of resamples
    under the estimate, ties by half)``, p, adjusted, step_alpha, rejected, adjusted_lo, adjusted_hi``: the last two at the level 1 - step_alpha.  Equal p keep the
    order of the arms' names.  An arm without a document of the baseline's has no row.  Arms are a table's few columns.
    """
    arms = sorted(r.arm for r in values.select("arm").distinct().collect())
    if baseline not in arms:
        raise ValueError(f"no values of the baseline {baseline}")
    if len(arms) == 1:
        return spark.createDataFrame([], _CONTRASTS)
    base = values.filter(F.col("arm") == baseline).select("doc_class", "doc", F.col(value).alias("_base"))
    others = values.filter(F.col("arm") != baseline)
    pairs = others.join(base, ["doc_class", "doc"]).select("arm", "doc_class", "doc", (F.col(value) - F.col("_base")).alias("_delta"))
    number = {arm: i for i, arm in enumerate(a for a in arms if a != baseline)}
    own = lambda i, arm, x: F.coalesce(F.sum(F.when(F.col("arm") == arm, x)), F.lit(0)).alias(f"{'dn'[i]}{number[arm]}")
    wide = pairs.groupBy("doc_class", "doc").agg(*[own(i, arm, x) for arm in number for i, x in ((0, F.col("_delta")), (1, F.lit(1)))])
    columns = [f"{x}{i}" for i in number.values() for x in "dn"]
    wide = base.select("doc_class", "doc").join(wide, ["doc_class", "doc"], "left").fillna(0, columns)
    closings = {arm: (lambda s, i=i: F.try_divide(s(f"d{i}"), s(f"n{i}").cast("double"))) for arm, i in number.items()}
    found = resampled(spark, wide, columns, closings, ["doc_class", "doc"], stratum, seed, resamples)
    docs = {r.arm: r.docs for r in pairs.groupBy("arm").agg(F.count(F.lit(1)).alias("docs")).collect()}
    rows = []
    for i, arm in enumerate(number):
        if arm in docs:
            r, ci = found[arm], found[arm].interval(level)
            rows.append((i, arm, docs[arm], r.estimate, ci.lo, ci.hi, ci.method, r.acceleration, _below(r.estimate, r.boot), ci.p_zero))
    tests = spark.createDataFrame(rows, "ord int, contrast string, docs long, estimate double, lo double, hi double, method string, acceleration double, below double, p double")
    done = holm(tests.withColumn("_family", F.lit(0)), ["_family"], alpha=alpha).drop("_family")
    wider = [(r.contrast, *_ends(found[r.contrast].interval(1 - r.step_alpha))) for r in done.select("contrast", "step_alpha").collect()]
    return done.join(spark.createDataFrame(wider, "contrast string, adjusted_lo double, adjusted_hi double"), "contrast")


_CONTRASTS = (
    "contrast string, ord int, docs long, estimate double, lo double, hi double, method string, acceleration double, below double, p double, "
    "adjusted double, step_alpha double, rejected boolean, adjusted_lo double, adjusted_hi double"
)


def _ends(ci: Interval) -> tuple[float, float]:
    return ci.lo, ci.hi


def interval_of(strata: list[list], statistic: Callable[[list], float], seed: int = SEED, resamples: int = RESAMPLES, level: float = 0.95) -> Interval:
    """Any pure statistic of a list of clusters, additive or not, as one loop: for statistics of a few documents, and to test the others by."""
    everything = [c for s in strata for c in s]
    if not everything or any(not s for s in strata):
        raise ValueError("every stratum needs a cluster")
    rng = Rng(seed)
    boot = [statistic([s[rng.int(len(s))] for s in strata for _ in s]) for _ in range(resamples)]
    places = [(k, i) for k, s in enumerate(strata) for i in range(len(s))]
    jack = [] if len(everything) == 1 else [statistic([c for (k, i), c in zip(places, everything, strict=True) if (k, i) != out]) for out in places]
    return _bca(statistic(everything), boot, _acceleration(jack), level)


def paired_deltas(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Documents of both arms as clusters of one delta each (a - b)."""
    left, right = a.select("doc_class", "doc", F.col(value).alias("_a")), b.select("doc_class", "doc", F.col(value).alias("_b"))
    return left.join(right, ["doc_class", "doc"]).select("doc_class", "doc", (F.col("_a") - F.col("_b")).alias("total"), F.lit(1).cast("long").alias("n"))


def holm(tests: DataFrame, by: list[str], p: str = "p", order: str = "ord", alpha: float = 0.05) -> DataFrame:
    """Adds ``adjusted``, ``step_alpha`` and ``rejected`` by Holm's step-down; equal p keep the order of ``order``.

    A family is a published table's contrasts: a few rows.
    """
    w = Window.partitionBy(*by).orderBy(p, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    if tests.filter(~F.coalesce(F.col(p).between(0, 1), F.lit(False))).first():
        raise ValueError("a p-value must be in [0, 1]")
    left = F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w) + 1
    rows = tests.withColumn("_left", left)
    return (
        rows.withColumn("adjusted", F.max(F.least(F.lit(1.0), F.col("_left") * F.col(p))).over(run))
        .withColumn("step_alpha", F.lit(alpha) / F.col("_left"))
        .withColumn("rejected", F.min(F.col(p) <= F.col("step_alpha")).over(run))
        .drop("_left")
    )


def jackknife(clusters: DataFrame, by: list[str]) -> DataFrame:
    """Leave-one-out means of each cluster: ``jack``; groups' sums come from one aggregation and are joined back."""
    sums = clusters.groupBy(*by).agg(F.sum("total").alias("_t"), F.sum("n").alias("_n"))
    left = clusters.join(sums, by)
    return left.withColumn("jack", F.try_divide(F.col("_t") - F.col("total"), (F.col("_n") - F.col("n")).cast("double"))).drop("_t", "_n")


def percentile_interval(sums: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """Plain percentile interval of resample means, exact percentiles."""
    mean = F.col("total") / F.col("n")
    tail = (1 - level) / 2
    return sums.groupBy(*by).agg(F.percentile(mean, F.lit(tail)).alias("lo"), F.percentile(mean, F.lit(1 - tail)).alias("hi"), F.avg(mean).alias("mean"))
