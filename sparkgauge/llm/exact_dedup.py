"""Exact duplicates through a cuckoo-filter index of live digests.

A text's key is the SHA-256 of it without white space.  Keys are dealt to tasks by their
value; a task keeps a cuckoo filter (16-bit fingerprints, four to a bucket) and, apart from it, the content of the
buckets: the keys and what is known of them, in flat arrays.  A key that the filter misses is certainly new and
no content is read; a hit is verified against the keys stored in the bucket.  When a better row of a group arrives, the
live row changes in place; digests that are withdrawn are deleted (``update_index``).  A filter that
overflows is rebuilt at twice the size from the stored keys.

The number of tasks grows with the number of rows, so that an index holds a bounded number of keys.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialise, partitions

#: Slots of a bucket, and moves tried before the filter is resized.
BUCKET_SLOTS = 4
MAX_MOVES = 200
KEY_BYTES = 32


class CuckooIndex:
    """Keys of 32 uniform bytes, each with ``fields`` integers: insertion, deletion, lookup.

    Each key has two buckets: one from its hash, the other that one xor a hash of its
    16-bit fingerprint, so either can be had from the other without the key.  A slot takes 2 bytes in the filter
    and 32 + 8 x fields in the content.
    """

    def __init__(self, buckets: int = 64, fields: int = 1):
        self.fields = fields
        self.size = 0
        self.resized = 0
        self._clear(1 << max(1, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        slots = buckets * BUCKET_SLOTS
        self.prints = array("H", bytes(2 * slots))
        self.keys = bytearray(KEY_BYTES * slots)
        self.values = array("q", bytes(8 * slots * self.fields))

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 8)) & self.mask

    def find(self, key: bytes) -> int:
        """The key's slot, or -1; stored keys are looked at only where the fingerprint hits."""
        mark = self._print(key)
        first = int.from_bytes(key[:8], "little") & self.mask
        prints, keys = self.prints, self.keys
        for bucket in (first, self._other(first, mark)):
            at = bucket * BUCKET_SLOTS
            for slot in range(at, at + BUCKET_SLOTS):
                if prints[slot] == mark and keys[slot * KEY_BYTES : (slot + 1) * KEY_BYTES] == key:
                    return slot
        return -1

    def get(self, key: bytes) -> tuple | None:
        """The values stored with a key; None if it isn't there."""
        slot = self.find(key)
        return None if slot < 0 else self._read(slot)[1]

    def put(self, slot: int, values: tuple) -> None:
        """Other values for the key of a slot."""
        self.values[slot * self.fields : (slot + 1) * self.fields] = array("q", values)

    def __contains__(self, key: bytes) -> bool:
        return self.find(key) >= 0

    def __len__(self) -> int:
        return self.size

    def insert(self, key: bytes, values: tuple) -> None:
        """Add a key that isn't there."""
        left = self._place((key, values))
        while left is not None:
            left = self._grow(left)
        self.size += 1

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        self.prints[slot] = 0
        self.size -= 1
        return True

    def _read(self, slot: int) -> tuple:
        return bytes(self.keys[slot * KEY_BYTES : (slot + 1) * KEY_BYTES]), tuple(self.values[slot * self.fields : (slot + 1) * self.fields])

    def _write(self, slot: int, mark: int, entry: tuple) -> None:
        self.prints[slot] = mark
        self.keys[slot * KEY_BYTES : (slot + 1) * KEY_BYTES] = entry[0]
        self.put(slot, entry[1])

    def _place(self, entry: tuple) -> tuple | None:
        """Store an entry, moving others; the entry that found no place, if any."""
        mark = self._print(entry[0])
        bucket = int.from_bytes(entry[0][:8], "little") & self.mask
        turn = 0
        for moves in range(MAX_MOVES):
            for b in (bucket, self._other(bucket, mark)):
                at = b * BUCKET_SLOTS
                for slot in range(at, at + BUCKET_SLOTS):
                    if not self.prints[slot]:
                        self._write(slot, mark, entry)
                        return None
            bucket = self._other(bucket, mark) if moves % 2 else bucket
            turn = (turn + mark) % BUCKET_SLOTS
            slot = bucket * BUCKET_SLOTS + turn
            moved, was = self._read(slot), self.prints[slot]
            self._write(slot, mark, entry)
            entry, mark = moved, was
            bucket = self._other(bucket, mark)
        return entry

    def _grow(self, entry: tuple) -> tuple | None:
        """Rebuild at twice the size from the stored keys; the entry that found no place, if any."""
        stored = (self.mask, self.prints, self.keys, self.values)
        self.resized += 1
        for factor in (2, 4, 8, 16):
            self._clear(factor * (stored[0] + 1))
            if all(self._place(x) is None for x in self._stored(*stored[1:])):
                return self._place(entry)
        raise OverflowError("keys are not uniform")

    def _stored(self, prints: array, keys: bytearray, values: array) -> Iterator[tuple]:
        f = self.fields
        return ((bytes(keys[i * KEY_BYTES : (i + 1) * KEY_BYTES]), tuple(values[i * f : (i + 1) * f])) for i, p in enumerate(prints) if p)

    def items(self) -> Iterator[tuple]:
        return self._stored(self.prints, self.keys, self.values)


def text_key(column) -> F.Column:
    """SHA-256 (hex) of the text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(column, F.lit("")), SPACE_CHARS, ""), 256)


def _better(a: tuple, b: tuple) -> bool:
    """(code points, 1 if there is no doc_id, doc_id, row): more code points, then the smaller of the rest."""
    return a[0] > b[0] or a[0] == b[0] and a[1:] < b[1:]


class _Groups:
    """Groups of equal keys: key -> (code points, 1 if there is no doc_id, doc_id, row, rows of the group)."""

    def __init__(self, buckets: int = 1024):
        self.index = CuckooIndex(buckets, fields=5)

    def add(self, key: bytes, points: int, doc_id: int | None, row: int, rows: int) -> None:
        best = (points, int(doc_id is None), doc_id or 0, row)
        slot = self.index.find(key)
        if slot < 0:
            self.index.insert(key, (*best, rows))
            return
        *held, n = self.index._read(slot)[1]
        self.index.put(slot, (*(best if _better(best, tuple(held)) else held), n + rows))

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for item in self.index.items():
            rows.append(item)
            if len(rows) == 20_000:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        column = lambda i: pa.array([v[i] for _, v in rows], pa.int64())
        return pa.RecordBatch.from_pydict({
            "key": pa.array([k for k, _ in rows], pa.binary()), "points": column(0),
            "keep_id": pa.array([None if v[1] else v[2] for _, v in rows], pa.int64()), "keep_row": column(3), "group_size": column(4),
        })


#: Groups that a task holds before it passes them on, when it combines before the shuffle.
COMBINE_GROUPS = 200_000
#: Rows dealt to one index, in the mean (about 74 bytes each, twice that while it is rebuilt).
INDEX_ROWS = 1_000_000
_GROUP_SCHEMA = "key binary, points long, keep_id long, keep_row long, group_size long"


def _combine(batches: Iterator[pa.RecordBatch], bound: int | None) -> Iterator[pa.RecordBatch]:
    groups = _Groups()
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            groups.add(*row)
        if bound and len(groups.index) > bound:
            yield from groups.batches()
            groups = _Groups()
    yield from groups.batches()


def live_groups(rows: DataFrame, n: int) -> DataFrame:
    """One row per key out of n rows (key, points, keep_id, keep_row, group_size).

    Rows are combined before the shuffle, so a group that holds a third of all rows sends
    one row from each task; then tasks index the keys dealt to them.
    """
    parts = max(partitions(rows.sparkSession), -(-n // INDEX_ROWS))
    early = rows.mapInArrow(lambda it: _combine(it, COMBINE_GROUPS), _GROUP_SCHEMA)
    return early.repartition(parts, "key").mapInArrow(lambda it: _combine(it, None), _GROUP_SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """``row`` (a number of its own), ``doc_id, key, points`` of every row, written to the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(text_key(F.col("text"))).alias("key"), F.char_length(text).cast("long").alias("points"),
        ),
        "digests",
    )


def _groups_of(slim: DataFrame) -> DataFrame:
    rows = slim.select("key", "points", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    return live_groups(rows, slim.count())


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, with the row of its group that stays.

    Takes ``doc_id`` and ``text`` (further columns are not looked at).  Texts are equal when
    identical without white space; null counts as empty, so null, empty and blank texts are one
    group; a text is read whole, however long.  Of a group the row with the most code points stays, then that of the smallest
    ``doc_id`` (null after all); of rows equal in both, one.  An empty table gives no rows.
    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    slim = digests(docs)
    groups = materialise(_groups_of(slim), "digest-groups")
    # both sides are written tables, so a hot group's rows can be split
    return slim.join(groups.drop("points"), "key").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("key")).alias("text_sha256")
    )


def update_index(spark: SparkSession, old: str | None, new: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """A new version of a stored index: digests of ``removed`` texts are deleted, those of ``added`` ones inserted.

    ``old`` and ``new`` are folders (Parquet: ``key, points, keep_id, group_size``); ``old`` stays as it is, so a lost job is
    run again.  Each task loads the stored keys dealt to it into a cuckoo index, deletes, then inserts.  A removed digest that
    isn't there changes nothing; one that is removed and added is there anew.  Returns the new index.
    """
    parts: list[DataFrame] = []
    columns = ["key", "points", "keep_id", "keep_row", "group_size"]
    if old is not None:
        parts.append(spark.read.parquet(old).withColumn("keep_row", F.lit(-1).cast("long")).select(F.lit(0).alias("step"), *columns))
    if removed is not None:
        parts.append(_groups_of(digests(removed)).select(F.lit(1).alias("step"), *columns))
    if added is not None:
        parts.append(_groups_of(digests(added)).select(F.lit(2).alias("step"), *columns))
    if not parts:
        raise ValueError("nothing to index")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = materialise(rows, "index-steps")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()
        for batch in batches:
            for step, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if step == 1:
                    groups.index.delete(row[0])
                else:
                    groups.add(*row)
        yield from groups.batches()

    n = max(partitions(spark), -(-rows.count() // INDEX_ROWS))
    done = rows.repartition(n, "key").sortWithinPartitions("step").mapInArrow(apply, _GROUP_SCHEMA)
    done.drop("keep_row").write.mode("errorifexists").parquet(new)
    return spark.read.parquet(new)


#: The same groups in DuckDB's SQL, for tables whose doc_id are unique.
ORACLE_SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), grouped AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""
