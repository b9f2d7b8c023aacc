"""Seeded simulations: noise floor of ECE, consistency bands, minimum detectable effect.

Streams whose draws depend on what came before stay sequential inside one group; groups (a
size, a delta) run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import STEP, Rng, normal_quantile, quantile, uniforms
from . import metrics
from .order import numbered_rows, settled

#: Documents of a block, and simulations that one task row makes of it.
DOCUMENTS, SIMULATIONS = 4096, 50
#: Points of a block of a stream at least, blocks about at most, points before a block in which it falls in, blocks that a task walks at once, points that a task holds.
POINTS, BLOCKS, WARM, LANES, HELD = 4096, 65_536, 1500, 1024, 1 << 22


def plugin_ece(confidence: np.ndarray, correct: np.ndarray, bins: int = metrics.BINS) -> float:
    n = len(confidence)
    order = np.argsort(confidence, kind="stable")
    k = min(bins, n)
    edges = np.arange(k + 1) * n // k
    c = np.add.reduceat(confidence[order], edges[:-1])
    y = np.add.reduceat(correct[order].astype(float), edges[:-1])
    return float(np.abs(y - c).sum() / n)


def _gammas(seed: int, at: np.ndarray, kept: np.ndarray, shape: float) -> np.ndarray:
    """``Rng.gamma`` of many places of one stream at once; ``at`` (next draw) and ``kept`` (NaN: none) go on in place."""
    if shape < 1:
        g = _gammas(seed, at, kept, shape + 1)
        u = uniforms(seed, at)
        at += u == 0
        u = np.where(u == 0, uniforms(seed, at), u)
        at += np.uint64(1)
        return g * u ** (1 / shape)
    d = shape - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out, left = np.empty(len(at)), np.arange(len(at))
    while len(left):
        i, x = at[left], kept[left]
        fresh = np.flatnonzero(np.isnan(x))
        rest = np.full(len(left), np.nan)
        if len(fresh):
            j = i[fresh]
            u = uniforms(seed, j)
            if not u.all():
                j = j + (u == 0)
                u = uniforms(seed, j)
            radius, angle = np.sqrt(-2 * np.log(u)), 2 * math.pi * uniforms(seed, j + np.uint64(1))
            x[fresh], rest[fresh], i[fresh] = radius * np.cos(angle), radius * np.sin(angle), j + np.uint64(2)
        kept[left] = rest
        tried = 1 + c * x > 0
        u = uniforms(seed, i)
        at[left] = i + tried
        taken = tried & (u < 1 - 0.0331 * x**4)
        v = (1 + c * x) ** 3
        close = np.flatnonzero(tried & ~taken & (u > 0))
        taken[close] = np.log(u[close]) < 0.5 * x[close] ** 2 + d * (1 - v[close] + np.log(v[close]))
        out[left[taken]] = d * v[taken]
        left = left[~taken]
    return out


def _points(seed: int, at: np.ndarray, kept: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """The next confidence and outcome at many places of the stream."""
    x = _gammas(seed, at, kept, a)
    confidence = x / (x + _gammas(seed, at, kept, b))
    correct = uniforms(seed, at) < confidence
    at += np.uint64(1)
    return confidence, correct


def _until(seed: int, at: np.ndarray, kept: np.ndarray, end: np.ndarray, a: float, b: float) -> np.ndarray:
    """Goes on with each place to the first point that begins at ``end`` or later; how many points that are."""
    count, left = np.zeros(len(at), dtype=np.int64), np.flatnonzero(at < end)
    while len(left):
        i, k = at[left], kept[left]
        _points(seed, i, k, a, b)
        at[left], kept[left] = i, k
        count[left] += 1
        left = left[i < end[left]]
    return count


_ENTRY = "block long, at long, kept double, count long, end long, end_kept double"


def _entries(spark: SparkSession, seed: int, points: int, a: float, b: float) -> list[np.ndarray]:
    """``at, kept, count`` of blocks of the stream that hold ``points`` points or more: the first point that begins in a block, and the points of the block.

    How many draws a point takes hangs on the draws, but sequences that begin anywhere soon fall in with the right one.  So a block begins ``WARM`` points
    early, and its first point is right if the block before ends there; where it doesn't, the block is made again from that end.  A row a block reaches the driver.
    """
    probe, none = np.zeros(1, dtype=np.uint64), np.full(1, np.nan)
    for _ in range(WARM):
        _points(seed, probe, none, a, b)
    rate = int(probe[0]) / WARM  # draws a point
    size = math.ceil(rate * max(POINTS, points // BLOCKS))
    warm = math.ceil(rate * WARM)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, at, kept = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "at", "kept"))
            at, kept = at.astype(np.uint64), kept.astype(float)
            edge = (block * size).astype(np.uint64)
            _until(seed, at, kept, edge, a, b)
            first, first_kept = at.copy(), kept.copy()
            count = _until(seed, at, kept, edge + np.uint64(size), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, first.astype(np.int64), first_kept, count, at.astype(np.int64), kept)], names=["block", "at", "kept", "count", "end", "end_kept"])

    def run(block: np.ndarray, at: np.ndarray, kept: np.ndarray) -> dict[str, np.ndarray]:
        starts = spark.createDataFrame(pa.table({"block": block, "at": at, "kept": kept})).repartition(max(1, min(len(block), max(spark.sparkContext.defaultParallelism, len(block) // LANES))))
        found = starts.mapInArrow(go, _ENTRY).toArrow().sort_by("block")
        return {c: found.column(c).to_numpy(zero_copy_only=False).copy() for c in found.column_names}

    known: dict[str, np.ndarray] = {}
    while not known or known["count"].sum() < points:
        done = len(known["block"]) if known else 0
        have = int(known["count"].sum()) if known else 0
        block = np.arange(done, done + math.ceil((points - have) * rate * 1.01 / size) + 1)
        more = run(block, np.maximum(block * size - warm, 0), np.full(len(block), np.nan))
        known = {c: np.concatenate([known[c], more[c]]) for c in more} if known else more
        while len(bad := 1 + np.flatnonzero((known["at"][1:] != known["end"][:-1]) | ~((known["kept"][1:] == known["end_kept"][:-1]) | (np.isnan(known["kept"][1:]) & np.isnan(known["end_kept"][:-1]))))):
            again = run(bad, known["end"][bad - 1], known["end_kept"][bad - 1])
            for c in again:
                known[c][bad] = again[c]
    return [known[c] for c in ("at", "kept", "count")]


def noise_floor(spark: SparkSession, sizes: list[int], seed: int, sims: int = 1000, bins: int = metrics.BINS, a: float = 5, b: float = 1.5) -> DataFrame:
    """``n, mean, p05, p95`` of the plug-in ECE of a perfectly calibrated arm.

    Simulations of a size follow each other on one stream, as in a sequential loop.  Where each point begins is found block by block; a task then makes a few
    simulations, all their blocks at once, and holds ``HELD`` points or one simulation.
    """
    sizes = sorted(set(sizes))
    at, kept, count = _entries(spark, seed, max(sizes) * sims, a, b) if sizes else [np.zeros(0)] * 3
    ends = np.cumsum(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, low, high = row["n"], row["n"] * row["low"], row["n"] * row["high"]
                own = slice(np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1)
                place, rest, points = at[own].astype(np.uint64), kept[own].copy(), count[own]
                confidence, correct = np.empty((points.max(), len(place))), np.empty((points.max(), len(place)), bool)
                for i in range(len(confidence)):
                    confidence[i], correct[i] = _points(seed, place, rest, a, b)
                real = np.arange(len(confidence)) < points[:, None]
                before = int(ends[own][0] - points[0])
                confidence, correct = (x.T[real][low - before : high - before].reshape(-1, n) for x in (confidence, correct))
                found = [plugin_ece(c, y, bins) for c, y in zip(confidence, correct, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(found), pa.int64()), pa.array(found)], names=["n", "ece"])

    def close(group: pd.DataFrame) -> pd.DataFrame:
        found = group["ece"].tolist()  # a number a simulation
        return pd.DataFrame({"n": [group["n"].iloc[0]], "mean": [math.fsum(found) / sims], "p05": [quantile(found, 0.05)], "p95": [quantile(found, 0.95)]})

    rows = []
    for n in sizes:
        each = max(1, min(HELD // n, -(-sims // (2 * spark.sparkContext.defaultParallelism))))
        rows += [(n, s, min(sims, s + each)) for s in range(0, sims, each)]
    parts = spark.createDataFrame(rows, "n long, low long, high long").repartition(max(1, len(rows)), "n", "low")
    return parts.mapInArrow(run, "n long, ece double").groupBy("n").applyInPandas(close, "n long, mean double, p05 double, p95 double")


def consistency_bands(points: DataFrame, order: list[str], seed: int, sims: int = 1000, bins: int = metrics.BINS, level: float = 0.95) -> DataFrame:
    """Per bin the range of accuracies that calibrated points would show.

    A task draws all simulations of its points, draw s n + r for simulation s and the point at place r, and sends a count a bin and
    simulation; points are never multiplied.
    """
    placed = metrics.binned(points, [], order, bins).select("r", "n", "bin", "confidence", "correct")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            r, own, confidence = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("r", "bin", "confidence"))
            n = batch.column("n")[0].as_py()
            found, at = np.unique(own, return_inverse=True)
            for b in found.tolist():
                hits.setdefault(b, np.zeros(sims, dtype=np.int64))
            for s in range(sims):
                times = np.bincount(at[uniforms(seed, s * n + r) < confidence], minlength=len(found))
                for b, k in zip(found.tolist(), times.tolist(), strict=True):
                    hits[b][s] += k
        for b, k in hits.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sims, b)).cast(pa.int64()), pa.array(np.arange(sims)), pa.array(k)], names=["bin", "s", "hits"])

    tail = (1 - level) / 2
    sums = placed.select("r", "n", F.col("bin").cast("long").alias("bin"), "confidence").mapInArrow(draw, "bin long, s long, hits long").groupBy("bin", "s").agg(F.sum("hits").alias("hits"))
    seen = placed.groupBy("bin").agg(F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("bin_n"))
    simulated = sums.join(F.broadcast(seen.select(F.col("bin").cast("long").alias("bin"), "bin_n")), "bin").withColumn("x", F.col("hits") / F.col("bin_n"))
    bands = simulated.groupBy("bin").agg(F.percentile("x", F.lit(tail)).alias("lo"), F.percentile("x", F.lit(1 - tail)).alias("hi"))
    return seen.join(bands, "bin")


def _normal(seed: int, first: int, count: int) -> np.ndarray:
    """Normals ``first`` to ``first + count`` (excluded) of the stream that ``Rng(seed).normal()`` gives.

    Pair p is made of draws 2 p and 2 p + 1, and only a draw of zero as a pair's first is skipped, which moves all later ones by one.  A draw is zero
    only in state 0, so at one place in 2^32.
    """
    pairs = np.arange(first // 2, (first + count + 1) // 2, dtype=np.uint64)
    zero, skipped = (-seed * pow(STEP, -1, 1 << 32) - 1) % (1 << 32), 0
    at = pairs * np.uint64(2)
    while len(pairs) and zero <= int(at[-1]) + 1:
        # skips before this one have moved the pairs' first draws
        if (zero - skipped) % 2 == 0:
            at[at >= zero] += np.uint64(1)
            skipped += 1
        zero += 1 << 32
    radius = np.sqrt(-2 * np.log(uniforms(seed, at)))
    angle = 2 * math.pi * uniforms(seed, at + np.uint64(1))
    out = np.empty(2 * len(pairs))
    out[0::2], out[1::2] = radius * np.cos(angle), radius * np.sin(angle)
    return out[first % 2 : first % 2 + count]


def _wins(z: np.ndarray, fields: np.ndarray, za: float, zb: float, shared: float, spread: float) -> np.ndarray:
    """Per document the fields that arm b has right more than arm a; a document takes 1 + 3 normals a field."""
    common, own = math.sqrt(shared), math.sqrt(1 - shared)
    before = np.cumsum(fields) - fields
    doc = np.repeat(np.arange(len(fields)), fields)
    start = 3 * before + np.arange(len(fields))
    u = (spread * z[start])[doc]
    place = start[doc] + 1 + 3 * (np.arange(len(doc)) - before[doc])
    s = common * z[place]
    more = (s + own * z[place + 2] < zb + u).astype(np.int64) - (s + own * z[place + 1] < za + u)
    return np.bincount(doc, weights=more, minlength=len(fields)).astype(np.int64)


def _t_of(sums: list[tuple[int, int, int, int]]) -> float:
    """Paired t of documents' differences ``more / fields``, from (fields, documents, sum of more, sum of its square), in whole numbers."""
    n = sum(k for _, k, _, _ in sums)
    total = sum((Fraction(x, m) for m, _, x, _ in sums), Fraction(0))
    square = sum((Fraction(xx, m * m) for m, _, _, xx in sums), Fraction(0))
    mean, se = float(total / n), math.sqrt((square - total * total / n) / (n - 1) / n)
    return mean / se if se else (0.0 if mean == 0 else math.inf)


def _paired_t(rng: Rng, fields: list[int], base: float, delta: float, shared: float, spread: float) -> float:
    """One simulation as a sequential loop, for tests."""
    za, zb = (normal_quantile(min(0.999, max(0.001, x))) for x in (base, base + delta))
    common, own = math.sqrt(shared), math.sqrt(1 - shared)
    deltas = []
    for m in fields:
        u, more = spread * rng.normal(), 0
        for _ in range(m):
            s = common * rng.normal()
            first = s + own * rng.normal() < za + u
            more += (s + own * rng.normal() < zb + u) - first
        deltas.append(more / m)
    n = len(deltas)
    mean = sum(deltas) / n
    se = math.sqrt(sum((d - mean) ** 2 for d in deltas) / (n - 1) / n)
    return mean / se if se else (0.0 if mean == 0 else math.inf)


def _document_blocks(documents: DataFrame, order: list[str]) -> DataFrame:
    """``offset, fields``: runs of ``DOCUMENTS`` documents in order, and the normals of a simulation that come before each."""

    def pack(table: pa.Table) -> pa.Table:
        by = np.argsort(table.column("r").to_numpy(), kind="stable")
        fields = table.column("fields").to_numpy()[by]
        return pa.table({"block": pa.array([table.column("_block")[0].as_py()], pa.int64()), "takes": pa.array([int((1 + 3 * fields).sum())], pa.int64()), "fields": pa.array([fields], pa.list_(pa.int64()))})

    rows = numbered_rows(documents.select(*order, F.col("fields").cast("long").alias("fields")), [], order).withColumn("_block", F.floor(F.col("r") / DOCUMENTS))
    blocks = settled(rows.select("r", "fields", "_block").groupBy("_block").applyInArrow(pack, "block long, takes long, fields array<long>"))
    # a row a block
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("block", F.coalesce(F.sum("takes").over(earlier), F.lit(0)).alias("offset"))
    return blocks.join(F.broadcast(offsets), "block")


def detectable_effect(spark: SparkSession, fields: list[int] | DataFrame, base: float, grid: list[float], seed: int, shared: float = 0.6,
                      spread: float = 0.7, alpha: float = 0.05, power: float = 0.8, sims: int = 600, order: list[str] | None = None) -> dict:
    """Smallest delta of ``grid`` found with ``power``.

    ``fields`` holds a number a document: a list, or a table (``fields`` and the columns of ``order``, which tells documents apart).
    Each simulation draws what a sequential loop draws: how many normals a document takes is known beforehand, so a block of documents makes its own
    in any simulation.  What reaches the driver is a number a delta and simulation.
    """
    if not isinstance(fields, DataFrame):
        fields, order = spark.createDataFrame([(i, m) for i, m in enumerate(fields)], "at long, fields long"), ["at"]
    blocks = _document_blocks(fields, order)
    docs, takes, count = blocks.agg(F.coalesce(F.sum(F.size("fields")), F.lit(0)), F.sum("takes"), F.count(F.lit(1))).first()
    if docs < 2 or not 0 < base < 1 or not grid or min(grid) <= 0:
        raise ValueError("two documents, a base in (0, 1) and positive deltas are needed")
    usable = [0.0, *(d for d in sorted(set(grid)) if base + d < 1)]
    streams = [seed ^ 0x9E3779B9 if d == 0 else seed + round(d * 1e6) for d in usable]
    ends = [[normal_quantile(min(0.999, max(0.001, x))) for x in (base, base + d)] for d in usable]
    parts = -(-sims // SIMULATIONS)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, d = np.array(row["fields"], dtype=np.int64), row["stream"]
                kinds, kind = np.unique(own, return_inverse=True)
                out = []
                for s in range(row["part"] * SIMULATIONS, min(sims, (row["part"] + 1) * SIMULATIONS)):
                    z = _normal(streams[d], s * takes + row["offset"], int(own.sum()) * 3 + len(own))
                    more = _wins(z, own, *ends[d], shared, spread)
                    sums = (np.bincount(kind), np.bincount(kind, weights=more), np.bincount(kind, weights=more * more))
                    out += [(d, s, m, *x) for m, *x in zip(kinds.tolist(), *(x.astype(np.int64).tolist() for x in sums), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["stream", "s", "m", "k", "x", "xx"])

    each = blocks.withColumn("stream", F.explode(F.sequence(F.lit(0), F.lit(len(usable) - 1)))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread_out = each.select("offset", "fields", "stream", "part").repartition(min(count * parts * len(usable), 1_000), "offset", "stream", "part")
    sums = spread_out.mapInArrow(draw, "stream long, s long, m long, k long, x long, xx long").groupBy("stream", "s", "m").agg(*[F.sum(c).alias(c) for c in ("k", "x", "xx")])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["stream"], r["s"], abs(_t_of([(x["m"], x["k"], x["x"], x["xx"]) for x in r["sums"]]))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["stream", "s", "t"])

    closed = sums.groupBy("stream", "s").agg(F.collect_list(F.struct("m", "k", "x", "xx")).alias("sums")).mapInArrow(close, "stream long, s long, t double")
    found: dict[float, list[float]] = {d: [] for d in usable}
    for r in closed.collect():
        found[usable[r.stream]].append(r.t)
    threshold = quantile(found[0.0], 1 - alpha)
    table = [(d, sum(t > threshold for t in found[d]) / sims if d in found else math.nan) for d in sorted(grid)]
    return {"mde": next((d for d, p in table if p >= power), None), "grid": table, "null_threshold": threshold}
