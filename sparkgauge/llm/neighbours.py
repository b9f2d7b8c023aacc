"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: they are turned by rotations learned so that signs lose little
(iterative quantisation, started from several random rotations, whose bits stand side by
side).  A code is split into 16-bit substrings, each with an index of its own.  Codes that differ
in at most R bits differ in at most t(j) bits of some substring j, where the t(j) sum to
R - m + 1; so probing each index for the values within t(j) retrieves every code within R.
Those are verified on all bits and ranked again by the exact inner product.

For inner products, vectors get one more coordinate that makes all of them equally long (queries: 0), so the
order by angle is that by inner product.  Rotations are fitted on a bounded sample; R
is the distance that holds a given share of the true neighbours of a bounded sample of queries, found
against all rows.

Rows and queries meet in blocks: a block of rows is indexed once for a large block of queries, so rows are sent once for every
``BLOCK_QUERIES`` queries and a query leaves one list for every ``BLOCK_ROWS`` rows.  Vectors of different lengths have no inner
product: each length is a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions

#: Vectors on which rotations are fitted, and queries whose true neighbours set the radius.
FIT_VECTORS = 2048
FIT_QUERIES = 64
#: The share of those neighbours that the radius must hold.
COVERAGE = 0.97
ROTATIONS = 4
#: Short vectors get more rotations, so that codes have so many bits.
LEAST_BITS = 64
FIT_STEPS = 25
#: Rows and queries of a block (128 MB of vectors of 100 numbers); small tables are cut finer, down to LEAST_ROWS, to use all cores.
BLOCK_ROWS = 131_072
LEAST_ROWS = 8192
BLOCK_QUERIES = 32_768
SUB_BITS = 16
#: Queries verified at once, and the share of candidates beyond which codes are compared row by row.
VERIFY_QUERIES = 64
#: Queries whose candidates are held at once.
SEARCH_QUERIES = 512
DENSE = 0.1


@dataclass(frozen=True)
class Codes:
    """Rotations side by side, (d + 1, bits), the mean, the longest vector, the radius."""

    planes: np.ndarray
    mean: np.ndarray
    longest: float
    radius: int = 0

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors of length 1 whose angles order as inner products."""
        length = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.hstack([x / length, np.zeros_like(length)])
        return np.hstack([x / self.longest, np.sqrt(np.maximum(0.0, 1.0 - (length / self.longest) ** 2))])

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(n, bits / 16) substrings of the codes."""
        signs = (self.lift(x, query) - self.mean) @ self.planes > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u2")


def fit(sample: np.ndarray, longest: float, rotations: int = ROTATIONS, steps: int = FIT_STEPS, seed: int = 7) -> Codes:
    """Learn rotations: in turn take the signs, and the rotation that brings vectors nearest to them."""
    codes = Codes(np.zeros((sample.shape[1] + 1, 0)), np.zeros(sample.shape[1] + 1), longest)
    x = codes.lift(sample, False)
    mean = x.mean(axis=0)
    # a coordinate that is the same everywhere carries no bit; a far mean would make signs constant
    x = x - mean
    random = np.random.default_rng(seed)
    planes = []
    for _ in range(max(rotations, -(-LEAST_BITS // x.shape[1]))):
        r, _ = np.linalg.qr(random.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x, full_matrices=False)
            r = (u @ v).T
        planes.append(r)
    every = np.hstack(planes)
    bits = every.shape[1] // SUB_BITS * SUB_BITS
    return Codes(every[:, :bits], mean, longest)


def thresholds(radius: int, parts: int) -> np.ndarray:
    """t(j) that sum to radius - parts + 1, as equal as can be; -1: the index isn't probed."""
    want = radius - parts + 1
    low, more = divmod(want, parts)
    return np.array([low + (j < more) for j in range(parts)])


class MultiIndex:
    """Indexes of one block of codes, one for each substring: distinct values, and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.unique(codes[:, j], return_inverse=True) for j in range(codes.shape[1])]
        self.words = _words(codes)

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Bits that differ, (queries, rows)."""
        out = np.zeros((len(queries), len(self.codes)), dtype=np.uint16)
        for q, c in zip(_words(queries).T, self.words.T, strict=True):
            out += np.bitwise_count(q[:, None] ^ c[None, :])
        return out

    def candidates(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(queries, rows): the rows that probing the indexes retrieves, all within the radius among them."""
        hit = np.zeros((len(queries), len(self.codes)), dtype=bool)
        for j, t in enumerate(thresholds(radius, self.codes.shape[1])):
            if t >= 0:
                values, rows = self.tables[j]
                # the occupied values within t of the query's: fewer than the words within t once t is large
                near = np.bitwise_count(queries[:, j, None] ^ values[None, :]) <= t
                hit |= near[:, rows]
        return hit

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all codes within the radius."""
        out_q, out_i = [], []
        for at in range(0, len(queries), VERIFY_QUERIES):
            part = queries[at : at + VERIFY_QUERIES]
            hit = self.candidates(part, radius)
            if hit.mean() > DENSE:
                # most codes are candidates: comparing whole rows costs less than picking them out
                hit &= self.distances(part) <= radius
                q, i = np.nonzero(hit)
            else:
                q, i = np.nonzero(hit)
                far = np.bitwise_count(_words(part)[q] ^ self.words[i]).sum(axis=1, dtype=np.uint16)
                q, i = q[far <= radius], i[far <= radius]
            out_q.append(q + at)
            out_i.append(i)
        return np.concatenate(out_q), np.concatenate(out_i)


def _words(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words."""
    lack = -codes.shape[1] % 4
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, lack)))).view(np.uint64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _best(query: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: highest score, then smallest name."""
    order = np.lexsort((name, -score, query))
    q = query[order]
    first = np.append(True, q[1:] != q[:-1])
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


class Block:
    """One block of rows: its vectors and indexes."""

    def __init__(self, rows: pd.DataFrame, model: Codes):
        self.x, self.names, self.model = _matrix(rows["embedding"]), rows["vec_id"].to_numpy(), model
        self.index = MultiIndex(model.encode(self.x, False))

    def search(self, queries: pd.DataFrame, k: int) -> pd.DataFrame:
        """The k best rows for each query, of those within the radius (k at least, if there are so many)."""
        y, asked, names = _matrix(queries["embedding"]), queries["query_id"].to_numpy(), self.names
        codes = self.model.encode(y, True)
        q, i = self.index.within(codes, self.model.radius)
        few = np.flatnonzero(np.bincount(q, minlength=len(y)) <= k)
        if len(few):
            # widen: for these the nearest codes of the block, whatever their distance
            most = min(k + 1, len(self.x))
            near = np.argsort(self.index.distances(codes[few]), axis=1, kind="stable")[:, :most]
            both = np.unique(np.stack([np.append(q, np.repeat(few, most)), np.append(i, near.ravel())], axis=1), axis=0)
            q, i = both[:, 0], both[:, 1]
        other = names[i] != asked[q]
        q, i = q[other], i[other]
        score = np.empty(len(q))
        for at in range(0, len(q), 100_000):
            s = slice(at, at + 100_000)
            score[s] = np.einsum("ij,ij->i", y[q[s]], self.x[i[s]])
        at = _best(q, score, names[i], k)
        return pd.DataFrame({"query_id": asked[q[at]], "vec_id": names[i[at]], "score": score[at]})


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part: not null, not zero, all components finite."""
    e = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
        & F.exists("embedding", lambda v: v != 0)
    )


def _exact(rows: DataFrame, names: np.ndarray, queries: np.ndarray, model: Codes, k: int) -> DataFrame:
    """The k best of all rows for a few queries, with the distance of codes."""
    codes = model.encode(queries, True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            x, found = _matrix(rows["embedding"]), rows["vec_id"].to_numpy()
            score = queries @ x.T
            score[names[:, None] == found[None, :]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            far = MultiIndex(model.encode(x, False)).distances(codes)
            yield pd.DataFrame({
                "query_id": np.repeat(names, top.shape[1]), "vec_id": found[top.ravel()],
                "score": np.take_along_axis(score, top, 1).ravel(), "far": np.take_along_axis(far, top, 1).ravel().astype(np.int32),
            })

    out = rows.mapInPandas(run, "query_id long, vec_id long, score double, far int")
    return _ranked(out.filter("score > double('-infinity')"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def train(rows: DataFrame, queries: DataFrame, k: int, coverage: float = COVERAGE) -> Codes | None:
    """Rotations from at most FIT_VECTORS rows, the radius from at most FIT_QUERIES queries against all rows."""
    pick = lambda df, name, n: df.orderBy(F.xxhash64(name, F.lit("fit")), name).limit(n).toPandas()
    sample = pick(rows, "vec_id", FIT_VECTORS)
    if not len(sample):
        return None
    longest = rows.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)))).first()[0]
    model = fit(_matrix(sample["embedding"]), longest)
    asked = pick(queries, "query_id", FIT_QUERIES)
    if not len(asked):
        return None
    true = _exact(rows, asked["query_id"].to_numpy(), _matrix(asked["embedding"]), model, k).select("far").toPandas()["far"]
    radius = int(np.quantile(true.to_numpy(), coverage, method="higher")) if len(true) else 0
    return Codes(model.planes, model.mean, model.longest, radius)


def nearest(vectors: DataFrame, query_step: int = 20, k: int = 20, block_rows: int | None = None,
            block_queries: int = BLOCK_QUERIES, coverage: float = COVERAGE) -> DataFrame:
    """For each vector whose ``vec_id`` is divisible by ``query_step`` its k nearest found:
    ``query_id, rank, vec_id, score``.

    Takes ``vec_id`` and ``embedding`` (further columns are not looked at).  Rows with a null id or vector, a
    zero vector, or a null or non-finite component take no part.  Vectors of other lengths than the
    query's have no inner product with it and are not its candidates.  Rows with the query's own id are not its candidates; other
    repeated rows count each; where rows share a query's id, the first of their vectors in order of components asks.
    Ties in score go to the smaller ``vec_id``.  An empty table gives no rows.
    """
    rows = materialise(usable(vectors), "vectors")
    found = None
    for r in rows.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():  # a row a length
        part = _nearest(rows.filter(F.size("embedding") == r.d), r["count"], query_step, k, block_rows, block_queries, coverage)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a query id has vectors of several lengths only if its rows do; the lists are then one
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(rows: DataFrame, n: int, query_step: int, k: int, block_rows: int | None, block_queries: int, coverage: float) -> DataFrame | None:
    """``query_id, vec_id, score``: lists of vectors of one length, one for each block of rows; None without queries."""
    spark = rows.sparkSession
    queries = rows.filter(F.col("vec_id") % query_step == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    queries = materialise(queries, "query-vectors")
    model = train(rows, queries, k, coverage)
    if model is None:
        return None
    if block_rows is None:
        block_rows = max(LEAST_ROWS, min(BLOCK_ROWS, -(-n // partitions(spark))))
    blocks, asks = -(-n // block_rows), -(-queries.count() // block_queries)
    send = spark.sparkContext.broadcast(model)  # at most (d + 1) x 4 (d + 1) numbers
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", deal("vec_id", blocks)).withColumn("qb", every(asks))
    right = queries.withColumn("qb", deal("query_id", asks)).withColumn("rb", every(blocks))

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        # rows of one id all have one block, however many they are
        for at in range(0, len(rows), 2 * block_rows):
            block = Block(rows.iloc[at : at + 2 * block_rows], send.value)
            out += [block.search(queries.iloc[to : to + SEARCH_QUERIES], k) for to in range(0, len(queries), SEARCH_QUERIES)]
        return pd.concat(out)

    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(meet, "query_id long, vec_id long, score double")
