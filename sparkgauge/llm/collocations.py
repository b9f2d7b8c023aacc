"""Phrases of words that occur together more often than their parts tell, mined pass by pass with hashed buckets.

Pass k reads the texts once.  It counts exactly those k-word phrases that may be frequent, counts all phrases of k + 1
words that may be frequent in a table of buckets, and from the second pass on leaves to the next only the runs of words that such phrases cover.  A phrase may be frequent if both its parts of k - 1 words are (they are looked
up in a bit table of all frequent ones) and if the bucket that it fell into in the pass before reached the threshold.
Both tables only ever let too many phrases through: what is counted is counted by its words, so hashes
decide on cost, never on a result.

A task counts its texts by chunks with numpy and sends a row a phrase and chunk; buckets go as sparse blocks, their counts cut off at the
threshold, which leaves open only what is above it.  Sums, frequent phrases, cuts and ranks are DataFrame work keyed by
(lang, phrase), so no language is one task.  What is broadcast are bit tables of at most ``2 ** max_bits`` bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

#: A-Z become a-z, these characters end a piece, a tab parts words like a blank.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words that a task counts at once (about 100 bytes each).
CHUNK_WORDS = 750_000
#: Buckets of a block, as a power of two.
BLOCK_BITS = 16
_FOLD, _SALT = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_END, _NONE = 0, 1
_RAW = "lang string, phrase string, count long, block int, places binary, counts binary"


@dataclass(frozen=True)
class Rules:
    """``threshold``: occurrences a phrase needs; ``longest``: its most words; ``factor``: what a score is multiplied by; ``top``: phrases a
    language; ``share``: percent of a phrase's occurrences that lie in one longer candidate for it to go; ``max_bits``: size of the bit tables at most."""

    threshold: int = 100
    longest: int = 5
    factor: int = 1000
    top: int = 2000
    share: int = 100
    max_bits: int = 28


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint64(salt * _SALT & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class BitTable:
    """A set of hashes that knows all it holds, and takes a few others for its own."""

    bits: np.ndarray
    power: int
    salts: tuple[int, ...]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for s in self.salts:
            at = _mixed(h, s) >> np.uint64(64 - self.power)
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word)


def _power(wanted: float, most: int) -> int:
    return max(BLOCK_BITS, min(most, int(np.ceil(np.log2(max(wanted, 1))))))


class _Chunk:
    """Tokens of some documents, language by language: ids of (lang, word), with an end after each piece."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        number, parts = count(2), []
        self.spans: list[tuple[bytes, int, int]] = []
        own: dict[bytes, list[bytes]] = {}
        for lang, text in rows:
            own.setdefault(lang, []).append(text)
        named: list[tuple[bytes, bytes]] = [(b"", b"\n"), (b"", b"")]
        at = 0
        for lang, texts in own.items():
            known = defaultdict(number.__next__, {b"\n": _END, b"": _NONE})
            words = b"\n".join([*texts, b""]).translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
            ids = ids[ids != _NONE]
            # an end after an end parts nothing
            ids = ids[np.append(True, (ids[1:] != _END) | (ids[:-1] != _END))]
            parts.append(ids)
            self.spans.append((lang, at, at + len(ids)))
            at += len(ids)
            named += [(lang, w) for w in list(known)[2:]]
        self.ids = np.concatenate(parts)
        self.langs, self.words = zip(*named, strict=True)
        self.size = len(named)
        self.hashes = np.fromiter((_word_hash(*x) for x in named), dtype=np.uint64, count=len(named))
        ends = np.flatnonzero(self.ids == _END)
        self.room = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(len(self.ids))

    def kept(self, at: np.ndarray, k: int) -> tuple[list[bytes], list[bytes]]:
        """For each language the words that phrases of k words at ``at`` cover, with an end wherever one was left out."""
        change = np.zeros(len(self.ids) + 1, dtype=np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + k, -1)
        covered = np.cumsum(change[:-1]) > 0
        langs, texts = [], []
        for lang, a, b in self.spans:
            place = a + np.flatnonzero(covered[a:b])
            if len(place):
                ids = np.insert(self.ids[place], np.flatnonzero(np.diff(place) > 1) + 1, _END)
                langs.append(lang)
                texts.append(b" ".join([self.words[i] for i in ids.tolist()]))
        return langs, texts

    def phrase_hashes(self, most: int) -> list[np.ndarray]:
        """Hashes of the phrases of 1 to ``most`` words that begin at each token."""
        out = [self.hashes[self.ids]]
        for k in range(1, most):
            out.append(out[-1][:-1] * _FOLD + out[0][k:])
        return out

    def counted(self, at: np.ndarray, k: int) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Languages, phrases and counts of the k words at ``at``, told apart by their ids."""
        if k == 1:
            n = np.bincount(self.ids[at], minlength=self.size)
            own = np.flatnonzero(n).tolist()
            return [self.langs[i] for i in own], [self.words[i] for i in own], n[own]
        code = self.ids[at].astype(np.int64)
        for j in range(1, k):
            if len(code) and int(code.max()) >= (1 << 62) // self.size:
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            code = code * self.size + self.ids[at + j]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        own = [self.ids[at[first] + j].tolist() for j in range(k)]
        return [self.langs[i] for i in own[0]], [b" ".join([self.words[i] for i in x]) for x in zip(*own, strict=True)], n


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Chunk]:
    rows, size = [], 0
    for batch in batches:
        for lang, text in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "text")), strict=True):
            rows.append((lang, text))
            size += len(text) // 4
            if size >= CHUNK_WORDS:
                yield _Chunk(rows)
                rows, size = [], 0
    if rows:
        yield _Chunk(rows)


def _row(lang=None, phrase=None, n=None, block=None, places=None, counts=None) -> pa.RecordBatch:
    size = len(block if lang is None else lang)
    fill = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(x, kind)
    text = lambda x: fill(x, pa.binary()).cast(pa.string())
    columns = [text(lang), text(phrase), fill(n, pa.int64()), fill(block, pa.int32()), fill(places, pa.binary()), fill(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "count", "block", "places", "counts"])


def _blocks(at: np.ndarray, threshold: int) -> pa.RecordBatch:
    """Places of a table with how often each is met, as rows of blocks; counts are cut off at the threshold."""
    place, n = np.unique(at, return_counts=True)
    n = np.minimum(n, threshold).astype(np.min_scalar_type(threshold))
    block = (place >> np.uint64(BLOCK_BITS)).astype(np.int64)
    low = (place & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)
    own, first = np.unique(block, return_index=True)
    cuts = list(pairwise([*first, len(place)]))
    return _row(block=own.astype(np.int32), places=[low[a:b].tobytes() for a, b in cuts], counts=[n[a:b].tobytes() for a, b in cuts])


def _table(rows: DataFrame, power: int, salts: tuple[int, ...], threshold: int) -> BitTable:
    """The places that reach the threshold over all tasks; blocks are summed where they are, bits are gathered."""
    kind = np.min_scalar_type(threshold)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts")), strict=True):
                own = sums.setdefault(block, np.zeros(1 << BLOCK_BITS, dtype=kind))
                at = np.frombuffer(places, dtype=np.uint16)
                own[at] = np.minimum(own[at].astype(np.int64) + np.frombuffer(counts, dtype=kind), threshold)
        done = {b: np.packbits(s >= threshold, bitorder="little").tobytes() for b, s in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32()), pa.array(done.values(), pa.binary())], names=["block", "bits"])

    bits = np.zeros(1 << (power - 3), dtype=np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    spread = rows.select("block", "places", "counts").repartition(min(partitions(rows.sparkSession), 1 << (power - BLOCK_BITS)), "block")
    for r in spread.mapInArrow(add, "block int, bits binary").collect():  # at most 2 ** (max_bits - 3) bytes
        bits[r.block * step : (r.block + 1) * step] = np.frombuffer(r.bits, dtype=np.uint8)
    return BitTable(bits, power, salts)


def _frequent_table(frequent: DataFrame, most: int) -> BitTable:
    """Bits of all frequent phrases of one length: 16 a phrase, as far as the bound allows."""
    power, salts = _power(16 * frequent.count(), most), (101, 102)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, dtype=np.uint64)
            for i, (lang, phrase) in enumerate(zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "phrase")), strict=True)):
                h = 0
                for word in phrase.split(b" "):
                    h = (h * int(_FOLD) + _word_hash(lang, word)) & (1 << 64) - 1
                found[i] = h
            if len(found):
                yield _blocks(np.concatenate([_mixed(found, s) >> np.uint64(64 - power) for s in salts]), 1)

    return _table(frequent.select("lang", "phrase").mapInArrow(mark, _RAW), power, salts, 1)


def _pass(docs: DataFrame, k: int, rules: Rules, power: int, parts: BitTable | None, buckets: BitTable | None) -> DataFrame:
    """Counts of phrases of k words, buckets of those of k + 1, and the texts that are left, in one reading."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((parts, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, buckets = sent.value
        for chunk in _chunks(batches):
            h, n = chunk.phrase_hashes(k + (k < rules.longest)), len(chunk.ids)
            if n < k:
                continue
            may = chunk.room[: n - k + 1] >= k
            if parts is not None:
                whole = parts.has(h[k - 2])
                may &= whole[: n - k + 1] & whole[1 : n - k + 2]
                at = np.flatnonzero(may)
                may[at] = buckets.has(h[k - 1][at])
            if may.any():
                yield _row(*chunk.counted(np.flatnonzero(may), k))
            if k < rules.longest:
                at = np.flatnonzero(may[:-1] & may[1:] & (chunk.room[: n - k] > k))
                if len(at):
                    yield _blocks(_mixed(h[k][at], k + 1) >> np.uint64(64 - power), rules.threshold)
                    if k > 1:
                        yield _row(*chunk.kept(at, k + 1))

    return materialise(docs.mapInArrow(run, _RAW), f"phrases-{k}")


def frequent_phrases(docs: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that reach the threshold (``lang, phrase, words, f``), and all words of each language (``lang, n``)."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    power = _power(size / 64, rules.max_bits)
    parts = buckets = n = None
    found = []
    for k in range(1, rules.longest + 1):
        raw = _pass(own, k, rules, power, parts, buckets)
        counts = raw.filter("count is not null")
        if k == 1:
            n = materialise(counts.groupBy("lang").agg(F.sum("count").alias("n")), "words")
        frequent = counts.groupBy("lang", "phrase").agg(F.sum("count").alias("f")).filter(F.col("f") >= rules.threshold)
        found.append(materialise(frequent.select("lang", "phrase", F.lit(k).alias("words"), "f"), f"frequent-{k}"))
        if k < rules.longest:
            parts = _frequent_table(found[-1], rules.max_bits)
            buckets = _table(raw.filter("block is not null"), power, (k + 1,), rules.threshold)
        if k > 1:
            own = raw.filter("count is null and block is null").select("lang", F.col("phrase").alias("text"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, n


def mine_collocations(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases by the score of their weakest cut.

    Takes ``text`` and ``lang`` of ``docs``, further columns are not looked at.  A null text counts as empty, a null language as ``und``; long texts are read whole; repeated rows
    count as often as they stand there.  Equal scores go by ``a``, then by the phrase's bytes, so ranks are unique.  An empty table gives no rows.
    A phrase needs the threshold in one language; of equal cuts the first counts.
    """
    known, n = frequent_phrases(docs, rules)
    candidates = known.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda w, start, length: F.array_join(F.slice(w, start, length), " ")
    # every shorter run of words that a candidate holds, with the most occurrences of one that holds it
    w = F.col("w")
    inside = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    held = candidates.filter(F.size(w) > 2).select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < rules.share * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(w, F.lit(1), F.col("k")).alias("head"), part(w, F.col("k") + 1, F.size(w) - F.col("k")).alias("tail"))
    for side, count_ in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count_)), ["lang", side])
    # 38 digits hold factor x a x n and l x r: counts below 10^15
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.join(n, "lang").withColumn("over", (wide("a") * wide("n") * F.lit(rules.factor).cast("decimal(5,0)")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then of the language: no task sorts more than the parts' first
    some = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= rules.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= rules.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(rules: Rules = Rules()) -> str:
    lengths = ", ".join(f"({k})" for k in range(1, rules.longest + 1))
    return rf"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM docs
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM pieces, (VALUES {lengths}) lengths(k) WHERE len(w) >= k
), known AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= {rules.threshold}
), words AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY 1
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE k > 1
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.a >= {rules.share} * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS i FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, a, i, h.f AS l, t.f AS r, n, ({rules.factor}::HUGEINT * a * n // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN known h ON h.lang = c.lang AND h.phrase = c.head JOIN known t ON t.lang = c.lang AND t.phrase = c.tail JOIN words x ON x.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY rank <= {rules.top}
"""
