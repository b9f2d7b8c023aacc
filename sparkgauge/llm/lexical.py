"""Ranked lexical search over an index of impacts cut into bit slices.

What a term adds to a document's score, its impact, is known when the index is built.  Documents lie in blocks; in a block each
term has a bitmap for every bit of its impacts: bit d of slice b says whether bit b of the impact in document d is set.  A query adds
the slices of its terms with carries, all documents of a block at once, 64 to a machine word.  The sum is sliced as well, so
the k best are found from the highest slice down: those that have a bit are ahead of those that lack it.

The index is a table in the shared folder, a row a block, built in two readings of what came before: postings (from the texts), impacts (from postings,
once document frequencies are known).  Only terms that some query holds are indexed.  A task of a search keeps the k best of each query
over its blocks, so what is shuffled is k rows a query and task.  Queries go in lots of bounded size, which are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialise

#: Letters, digits and all characters beyond ASCII make up terms; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of a block (16 words of 64 bits), and (document, term) pairs after which a block ends early: a row of either table has a few MB.
BLOCK_DOCS, BLOCK_POSTINGS = 1024, 250_000
#: Rows are large, so row groups are small and their size is looked at row by row: a writer holds one in memory.
_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}
#: (query, term) pairs of a lot at about 100 bytes each: a lot's terms and weights are what is broadcast.
LOT_PAIRS = 500_000
#: Terms added at once.
ADD_TERMS = 128
_POSTINGS = "ids array<bigint>, sizes array<bigint>, n_docs bigint, n_terms bigint, terms array<string>, dfs array<bigint>, places array<binary>, tfs array<binary>"
_INDEX = "ids array<bigint>, terms array<string>, words array<binary>, slices array<binary>"


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and of each indexed term the documents that hold it."""

    docs: int
    terms: int
    frequency: dict[bytes, int]

    def weights(self) -> dict[bytes, int]:
        return {t: math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1))) for t, df in self.frequency.items()}


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    statistics: Statistics


def query_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """``item_id, term``, each once; rows of one id are one query."""
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


class _Postings:
    """The block that a task fills."""

    def __init__(self):
        self.ids, self.sizes, self.held, self.terms = [], [], [], []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes | None, number: dict[bytes, int]) -> None:
        words = text.translate(_TABLE).split() if text else []
        at = np.fromiter((i for i in map(number.get, words) if i is not None), dtype=np.int64)
        own, tf = np.unique(at, return_counts=True)
        self.held.append((own, tf))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.postings += len(own)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS

    def row(self, names: list[bytes]) -> pa.RecordBatch:
        term = np.concatenate([h[0] for h in self.held])
        tf = np.concatenate([h[1] for h in self.held])
        place = np.repeat(np.arange(len(self.held)), [len(h[0]) for h in self.held])
        order = np.argsort(term, kind="stable")
        own, first = np.unique(term[order], return_index=True)
        cuts = list(pairwise([*first, len(term)]))
        place, tf = place[order].astype(np.uint16), tf[order].astype(np.uint32)
        n_docs, n_terms = sum(n > 0 for n in self.sizes), sum(self.sizes)
        one = lambda x, kind: pa.array([x], kind)
        many = lambda kind: pa.list_(kind)
        return pa.RecordBatch.from_arrays(
            [
                one(self.ids, many(pa.int64())), one(self.sizes, many(pa.int64())), one(n_docs, pa.int64()), one(n_terms, pa.int64()),
                one([names[t].decode() for t in own], many(pa.string())), one([b - a for a, b in cuts], many(pa.int64())),
                one([place[a:b].tobytes() for a, b in cuts], many(pa.binary())), one([tf[a:b].tobytes() for a, b in cuts], many(pa.binary())),
            ],
            names=["ids", "sizes", "n_docs", "n_terms", "terms", "dfs", "places", "tfs"],
        )


def term_slices(value: np.ndarray, place: np.ndarray, n: np.ndarray) -> list[tuple[bytes, bytes] | None]:
    """For each term the words that hold a document of it, and those words of each slice, the lowest first; null where all values are zero.

    ``n``: how many of the values, with their places in ascending order, are each term's.
    """
    term = np.repeat(np.arange(len(n)), n)
    key = (term << 16) | (place >> 6)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    bit, bits = np.uint64(1) << (place & 63).astype(np.uint64), int(value.max()).bit_length()
    slices = np.empty((bits, len(starts)), dtype=np.uint64)
    for b in range(bits):
        slices[b] = np.bitwise_or.reduceat(np.where((value >> b) & 1, bit, np.uint64(0)), starts)
    word = (place[starts] >> 6).astype(np.uint8)
    first = np.cumsum(n) - n
    most = np.maximum.reduceat(value, first).tolist()
    cuts = np.searchsorted(term[starts], np.arange(len(n) + 1)).tolist()
    return [(word[a:b].tobytes(), slices[: m.bit_length(), a:b].tobytes()) if m else None for m, (a, b) in zip(most, pairwise(cuts), strict=True)]


def build_index(docs: DataFrame, vocabulary: list[bytes]) -> Index:
    """Index ``docs`` (``doc_id, text``) for a bounded list of terms."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(vocabulary)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        number = {t: i for i, t in enumerate(names)}
        block = _Postings()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
                block.add(doc_id.as_py(), text.as_py(), number)
                if block.full():
                    yield block.row(names)
                    block = _Postings()
        if block.ids:
            yield block.row(names)

    postings = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(post, _POSTINGS), "postings", **_GROUPS)
    n = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    each = postings.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    # at most as many rows as the vocabulary has terms
    statistics = Statistics(n[0], n[1], {r.terms.encode(): r.df for r in each.collect()})
    weigh = sc.broadcast((statistics.docs, statistics.terms, statistics.weights()))

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_terms, weight = weigh.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "sizes", "terms", "dfs", "places", "tfs")}
                m = 50 + 50 * np.array(row["sizes"], dtype=np.int64) * n_docs // max(1, n_terms)
                n, found = np.array(row["dfs"], dtype=np.int64), []
                if len(n):
                    at = np.frombuffer(b"".join(row["places"]), dtype=np.uint16).astype(np.int64)
                    times = np.frombuffer(b"".join(row["tfs"]), dtype=np.uint32).astype(np.int64)
                    own = np.repeat(np.array([weight[t.encode()] for t in row["terms"]], dtype=np.int64), n)
                    found = [(t, x) for t, x in zip(row["terms"], term_slices(own * (1_000_000_000 * times // (1000 * times + 20 * m[at])), at, n), strict=True) if x]
                columns = [pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([[t for t, _ in found]], pa.list_(pa.string())), *(pa.array([[x[k] for _, x in found]], pa.list_(pa.binary())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "words", "slices"])

    return Index(materialise(postings.mapInArrow(impacts, _INDEX), "impacts", **_GROUPS), statistics)


def add_slices(x: np.ndarray) -> np.ndarray:
    """Sum of numbers in slices, (bits, numbers, words) -> (more bits, words), two by two with carries."""
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        a, b = x[:, :half], x[:, half : 2 * half]
        out = np.zeros((len(x) + 1, half + x.shape[1] % 2, x.shape[2]), dtype=np.uint64)
        if x.shape[1] % 2:
            out[:-1, half] = x[:, -1]
        carry = np.zeros_like(a[0])
        for k in range(len(x)):
            differ = a[k] ^ b[k]
            out[k, :half] = differ ^ carry
            carry = (a[k] & b[k]) | (carry & differ)
        out[-1, :half] = carry
        x = out if out[-1].any() else out[:-1]
    return x[:, 0]


def _places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def best_places(total: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k largest above zero, from the highest slice down; of equal ones those that come first in ``order``."""
    ahead = np.zeros_like(total[0])
    tied = np.bitwise_or.reduce(total, axis=0)
    n_ahead = 0
    if int(np.bitwise_count(tied).sum()) <= k:
        ahead, tied = tied, ahead
    else:
        for s in total[::-1]:
            have = tied & s
            n = int(np.bitwise_count(have).sum())
            if n_ahead + n > k:
                tied = have
            else:
                ahead, n_ahead, tied = ahead | have, n_ahead + n, tied & ~s
                if n_ahead == k:
                    tied = np.zeros_like(tied)
                    break
    at, rest = _places(ahead), _places(tied)
    if len(rest):
        at = np.concatenate([at, rest[np.argsort(order[rest], kind="stable")[: k - len(at)]]])
    bits = (total[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return at, (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


def _first(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((order, -score))[:k]


#: Stands for a missing doc_id among keys of order: after all others.
_LAST = np.iinfo(np.int64).max


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of each query of a bounded table ``item_id, term``."""
    kind = queries.schema["item_id"].dataType
    terms: dict = {}
    for r in queries.collect():
        terms.setdefault(r.item_id, []).append(r.term)
    sent = queries.sparkSession.sparkContext.broadcast([(i, sorted(ts)) for i, ts in terms.items()])
    arrow = to_arrow_type(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                known = np.asarray(ids.is_valid())
                order = np.where(known, np.asarray(ids.fill_null(0)), _LAST)
                wide = (len(order) + 63) // 64
                number = {t: i for i, t in enumerate(batch.column("terms")[row].as_py())}
                words, slices = batch.column("words")[row].values, batch.column("slices")[row].values
                for q, (_, ts) in enumerate(asked):
                    own = [number[t] for t in ts if t in number]
                    total = None
                    for at in range(0, len(own), ADD_TERMS):
                        parts = []
                        for i in own[at : at + ADD_TERMS]:
                            w = np.frombuffer(words[i].as_buffer(), dtype=np.uint8)
                            parts.append((w, np.frombuffer(slices[i].as_buffer(), dtype=np.uint64).reshape(-1, len(w))))
                        high = max(len(s) for _, s in parts)
                        x = np.zeros((high, len(parts), wide), dtype=np.uint64)
                        for j, (w, s) in enumerate(parts):
                            x[: len(s), j, w] = s
                        some = add_slices(x)
                        if total is not None:
                            both = np.zeros((max(len(total), len(some)), 2, wide), dtype=np.uint64)
                            both[: len(total), 0], both[: len(some), 1] = total, some
                            some = add_slices(both)
                        total = some
                    if total is None:
                        continue
                    at, score = best_places(total, k, order)
                    found, points = order[at], score
                    if q in best:
                        found, points = np.concatenate([best[q][0], found]), np.concatenate([best[q][1], points])
                        top = _first(points, found, k)
                        found, points = found[top], points[top]
                    best[q] = (found, points)
        if best:
            doc = np.concatenate([x[0] for x in best.values()])
            item = [asked[q][0] for q, x in best.items() for _ in range(len(x[0]))]
            yield pa.RecordBatch.from_arrays([pa.array(item, arrow), pa.array(doc, pa.int64(), mask=doc == _LAST), pa.array(np.concatenate([x[1] for x in best.values()]))], names=["item_id", "doc_id", "score"])

    schema = StructType([StructField("item_id", kind), StructField("doc_id", LongType()), StructField("score", LongType())])
    found = index.blocks.mapInArrow(scan, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(128)))
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, lot_pairs: int = LOT_PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of ``docs`` that score highest for each row of ``items``.

    Takes ``doc_id`` and ``text`` of ``docs``, ``item_id`` and ``text`` of ``items``; further columns are not looked at.  Null and empty texts have no
    terms and are found by no query; queries without terms find nothing.  Long texts are read whole.  Repeated rows are documents of their own; documents without an
    id come last among equal scores.  Empty tables give no rows.  Queries with more than ``lot_pairs`` terms in all go in several lots, each
    with an index of its terms.
    """
    pairs = materialise(query_terms(items), "queries")
    lots = -(-pairs.count() // lot_pairs)
    out = None
    for lot in range(max(1, lots)):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(max(1, lots))) == lot)
        vocabulary = sorted(r.term.encode() for r in own.select("term").distinct().collect())
        found = search(build_index(docs, vocabulary), own, k)
        out = found if out is None else out.unionByName(found)
    return out


def oracle_sql(k: int = 50) -> str:
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY 1, 2
), sizes AS (
  SELECT r, doc_id, len(w) AS n FROM docs WHERE len(w) > 0
), whole AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (r), whole GROUP BY 1, 2, 3
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= {k}
"""
