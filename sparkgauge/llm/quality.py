"""Quality by random-indexing word vectors pooled per document, and a two-layer network with a calibrated temperature, in numpy.

Random indexing: every word has a fixed sparse vector of +1 and -1, made from its hash.  A word's context vector is the sum of the
index vectors of all its neighbours, over all documents; sums are whole numbers, so they don't hang on the order or number
of tasks.  Words lie in a fixed number of buckets, so the table has one size however large the corpus is; tasks send the blocks of it that
they touched.  A document is pooled from its words: mean and spread of their context vectors, how alike neighbours are, how often
words repeat, at once and at all, and its length.

The network is fitted on the driver from pooled vectors of a bounded sample of labelled rows (``Limits``), its temperature on a
fifth of the sample that it isn't trained on.  No text goes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions
from .toxicity import held_out

BUCKET_BITS = 15
DIM = 32
#: Entries of an index vector that are +1, and as many that are -1; neighbours on each side.
SIDE, REACH = 2, 2
#: Buckets of a block of the table that is summed.
BLOCK = 512
HIDDEN = 32
#: Words that a task takes at once, and words whose buckets a worker keeps.
CHUNK_WORDS, KNOWN_WORDS = 250_000, 1_000_000
#: Context vectors of words met so often are halved.
RARE = 5.0
_BUCKETS, _GAP = 1 << BUCKET_BITS, 1 << BUCKET_BITS
#: Words, and runs of other signs; white space parts them.
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")
_FEATURES = 2 * DIM + 4


@dataclass(frozen=True)
class Limits:
    """The bounded sample of labelled rows: at most so many of each label, by hash of doc_id."""

    each: int = 20_000
    epochs: int = 60
    seed: int = 7


class _Known(dict):
    """Bucket of each word; a word as it is written, and its like in capitals, are different words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) >> (64 - BUCKET_BITS)
        return found


_KNOWN = _Known()


def index_places(seed: int = 1) -> np.ndarray:
    """Where the index vector of every bucket is +1 (first half) and -1; for the gap between documents a place beyond the vector."""
    r = np.random.default_rng(seed)
    at = np.argsort(r.random((_BUCKETS, DIM)), axis=1)[:, : 2 * SIDE]
    return np.vstack([at, np.full((1, 2 * SIDE), DIM)]).astype(np.int64)


def _tokens(text: bytes | None) -> np.ndarray:
    found = _TOKEN.findall(text) if text else []
    return np.fromiter(map(_KNOWN.__getitem__, found), dtype=np.int32, count=len(found))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of a batch with their words, as many at once as CHUNK_WORDS asks for."""
    for batch in batches:
        at, words, size = 0, [], 0
        texts = batch.column("text").cast(pa.binary())
        for i in range(batch.num_rows):
            words.append(_tokens(texts[i].as_py()))
            size += len(words[-1])
            if size >= CHUNK_WORDS or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at), words
                at, words, size = i + 1, [], 0


class ContextSums:
    """Sums of neighbours' index vectors and counts of words, by bucket."""

    def __init__(self):
        self.places = index_places()
        self.table = np.zeros((_BUCKETS, DIM + 1), dtype=np.int64)

    def add(self, words: list[np.ndarray]) -> None:
        gap = np.full(REACH, _GAP, dtype=np.int32)
        t = np.concatenate([x for w in words for x in (w, gap)]).astype(np.int64)
        # a row of the sums has a place more, where neighbours that are gaps go; so has the table a row for gaps
        row, near = t * (DIM + 1), self.places[t]
        size = (_BUCKETS + 1) * (DIM + 1)
        for side in (0, 1):
            own = near[:, side * SIDE : (side + 1) * SIDE]
            codes = np.concatenate([x for k in range(1, REACH + 1) for x in ((row[k:, None] + own[:-k]).ravel(), (row[:-k, None] + own[k:]).ravel())])
            sums = np.bincount(codes, minlength=size).reshape(-1, DIM + 1)
            self.table[:, :DIM] += (1, -1)[side] * sums[:_BUCKETS, :DIM]
        self.table[:, DIM] += np.bincount(t, minlength=_BUCKETS + 1)[:_BUCKETS]

    def rows(self) -> pa.RecordBatch:
        """The buckets that were met, by block."""
        met = np.flatnonzero(self.table[:, DIM])
        block, first = np.unique(met // BLOCK, return_index=True)
        cuts = list(pairwise([*first, len(met)]))
        return _sum_rows(block.tolist(), [met[a:b] % BLOCK for a, b in cuts], [self.table[met[a:b]] for a, b in cuts])


_SUMS = "block int, places binary, sums binary, wide boolean"


def _sum_rows(blocks: list[int], places: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
    wide = [bool(len(s)) and int(np.abs(s).max()) >= 1 << 31 for s in sums]
    raw = [s.astype(np.int64 if w else np.int32).tobytes() for s, w in zip(sums, wide, strict=True)]
    columns = [pa.array(blocks, pa.int32()), pa.array([p.astype(np.uint16).tobytes() for p in places], pa.binary()), pa.array(raw, pa.binary()), pa.array(wide, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "places", "sums", "wide"])


def _open(r) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["places"], dtype=np.uint16), np.frombuffer(r["sums"], dtype=np.int64 if r["wide"] else np.int32).reshape(-1, DIM + 1)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            place, own = _open(r)
            sums.setdefault(r["block"], np.zeros((BLOCK, DIM + 1), dtype=np.int64))[place] += own
    if sums:
        met = {b: np.flatnonzero(s[:, DIM]) for b, s in sums.items()}
        yield _sum_rows(list(sums), list(met.values()), [s[met[b]] for b, s in sums.items()])


def context_table(docs: DataFrame) -> np.ndarray:
    """Sums over all texts of ``docs``: (buckets, DIM + 1) whole numbers, the count last."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = ContextSums()
        for _, words in _chunks(batches):
            sums.add(words)
        yield sums.rows()

    rows = docs.select("text").mapInArrow(gather, _SUMS)
    blocks, n = _BUCKETS // BLOCK, partitions(docs.sparkSession)
    if n > 4 * blocks:  # many tasks send every block, so a block is summed in parts first
        rows = rows.repartition(n, "block", F.pmod(F.spark_partition_id(), F.lit(n // blocks))).mapInArrow(_add_blocks, _SUMS)
    out = np.zeros((_BUCKETS, DIM + 1), dtype=np.int64)
    for r in rows.repartition(min(n, blocks), "block").mapInArrow(_add_blocks, _SUMS).collect():
        place, own = _open(r)
        out[r.block * BLOCK + place.astype(np.int64)] += own
    return out


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Mean contexts less the corpus' own, smaller for rare words, of mean square 1; zeros for the gap."""
    n = table[:, DIM:].astype(np.float64)
    total = max(1.0, n.sum())
    mean = table[:, :DIM] / np.maximum(n, 1)
    own = (mean - table[:, :DIM].sum(axis=0) / total) * (n / (n + RARE))
    scale = np.sqrt((own * own * n).sum() / (total * DIM)) or 1.0
    return np.vstack([own / scale, np.zeros((1, DIM))]).astype(np.float32)


def pool(vectors: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A row of features for each document; zeros for one without words."""
    out = np.zeros((len(words), _FEATURES), dtype=np.float32)
    some = [i for i, w in enumerate(words) if len(w)]
    if not some:
        return out
    t = np.concatenate([words[i] for i in some])
    n = np.array([len(words[i]) for i in some])
    first = np.cumsum(n) - n
    own = vectors[t]
    square = own * own
    like = np.einsum("td,td->t", own[:-1], own[1:]) / DIM
    same = t[:-1] == t[1:]
    code = np.unique(np.repeat(np.arange(len(n)), n) * (_BUCKETS + 1) + t)
    distinct = np.bincount(code // (_BUCKETS + 1), minlength=len(n))
    ones = np.ones(int(n.max()), dtype=np.float32)
    for j, (i, a, size) in enumerate(zip(some, first, n, strict=True)):
        mean, pairs = ones[:size] @ own[a : a + size] / size, slice(a, a + size - 1)
        spread = ones[:size] @ square[a : a + size] / size - mean * mean
        out[i, :DIM], out[i, DIM : 2 * DIM] = mean, np.sqrt(np.maximum(0, spread))
        if size > 1:
            out[i, 2 * DIM : 2 * DIM + 2] = like[pairs].mean(), same[pairs].mean()
        out[i, 2 * DIM + 2 :] = np.log(distinct[j] / size), np.log1p(size)
    return out


@dataclass
class Network:
    """Two layers over standardised features; a probability is the logistic function of the logit over the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(0, z @ self.p["A"] + self.p["a"]) @ self.p["b"] + self.p["c"][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def gradients(p: dict[str, np.ndarray], z: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss."""
    h = z @ p["A"] + p["a"]
    on = np.maximum(0, h)
    d = (1 / (1 + np.exp(-np.clip(on @ p["b"] + p["c"][0], -30, 30))) - y) / len(y)
    back = d[:, None] * p["b"] * (h > 0)
    return {"A": z.T @ back, "a": back.sum(axis=0), "b": on.T @ d, "c": np.array([d.sum()])}


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least logistic loss, by halving on the loss' slope in 1 / T."""
    low, high = -4.0, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(logit * np.exp(mid), -30, 30)))
        low, high = (low, mid) if ((p - y) * logit).sum() > 0 else (mid, high)
    return float(np.exp(-low))


def train(x: np.ndarray, y: np.ndarray, aside: np.ndarray, limits: Limits = Limits()) -> Network:
    """Fit on rows that aren't ``aside``, calibrate on those that are (on all, if one side has one label only)."""
    r = np.random.default_rng(limits.seed)
    y = y.astype(np.float64)
    if len(set(y.tolist())) < 2:
        return Network(np.zeros(_FEATURES), np.ones(_FEATURES), {"A": np.zeros((_FEATURES, HIDDEN)), "a": np.zeros(HIDDEN), "b": np.zeros(HIDDEN), "c": np.array([4.0 if len(y) and y[0] else -4.0])})
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        fit = check = np.ones(len(y), dtype=bool)
    else:
        fit, check = ~aside, aside
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    p = {"A": r.standard_normal((_FEATURES, HIDDEN)) / np.sqrt(_FEATURES), "a": np.zeros(HIDDEN), "b": r.standard_normal(HIDDEN) / np.sqrt(HIDDEN), "c": np.zeros(1)}
    m, q = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rows, step, best = np.flatnonzero(fit), 0, (np.inf, p)
    for _ in range(limits.epochs):
        for part in np.array_split(r.permutation(rows), max(1, len(rows) // 128)):
            step += 1
            g = gradients(p, z[part], y[part])
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                q[k] += 0.001 * (g[k] * g[k] - q[k])
                p[k] = p[k] * (1 - 1e-5) - 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
        logit = np.maximum(0, z[check] @ p["A"] + p["a"]) @ p["b"] + p["c"][0]
        loss = float(np.logaddexp(0, np.where(y[check] > 0, -logit, logit)).mean())
        if loss < best[0]:
            best = (loss, {k: v.copy() for k, v in p.items()})
    net = Network(mean, scale, best[1])
    net.temperature = temperature(net.logits(x[check]), y[check])
    return net


def pooled(docs: DataFrame, table: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and ``features``, the pooled vector of its text."""
    sent = docs.sparkSession.sparkContext.broadcast(word_vectors(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in _chunks(batches):
            x = pool(sent.value, words)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(list(x), pa.list_(pa.float32()))], names=[*columns, "features"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)
    return docs.select(*columns, "text").mapInArrow(run, f"{schema}, features array<float>")


def fit(docs: DataFrame, labels: DataFrame, table: np.ndarray, limits: Limits = Limits()) -> Network:
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id", F.lit("quality"))
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy(order, "doc_id").limit(limits.each)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 x limits.each rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    found = pooled(texts, table, ["doc_id", "quality"]).withColumn("_hash", order).orderBy("_hash", "doc_id", "quality", "features").limit(2 * limits.each)
    rows = found.collect()
    x = np.array([r.features for r in rows], dtype=np.float32).reshape(-1, _FEATURES)
    return train(x, np.array([r.quality for r in rows], dtype=np.int64), np.array([r["_hash"] % 5 == 0 for r in rows], dtype=bool), limits)


def score(docs: DataFrame, table: np.ndarray, net: Network) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (``doc_id, text``)."""
    sent = docs.sparkSession.sparkContext.broadcast((word_vectors(table), net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value
        for rows, words in _chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(net.scores(pool(vectors, words)).astype(np.float64))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; word vectors are of all its texts.

    Takes ``doc_id`` and ``text`` of ``docs``, ``doc_id`` and ``quality`` of ``labels`` (further columns are not looked at).  Labels
    other than 0 and 1, and rows without an id, teach nothing; of an id with two labels both count.  Null counts as empty; an empty text is scored by what
    the network makes of zeros; a long one is read whole.  Equal texts get equal scores.  Without labels of both kinds every score is the same, on the side of the
    one there is (low without any).  An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = context_table(rows)
    net = fit(rows, labels, table, limits)
    return score(rows, table, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
