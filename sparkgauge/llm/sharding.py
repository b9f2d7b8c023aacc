"""Sharding through fixed virtual slots.

Records hash into a fixed number of slots; bytes and rows are added up per slot; a map from
slots to shards, kept in versions, gives each slot a shard so that shards have nearly equal
bytes.  When the number of shards changes, the map is edited: only as many slots move as
the balance needs, and a new version is stored beside the old one.

What reaches the driver is one row a slot (a fixed number), never rows of the table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, new_path

SLOTS = 16_384
#: How far above the mean a shard may be before slots move, as a share.
SLACK = 0.02
#: Rows of a virtual slot that one task numbers, in the mean; fuller slots are numbered in parts.
SLOT_ROWS = 1_000_000
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


@dataclass
class SlotMap:
    """slot -> shard, for ``shards`` shards; ``version`` grows by 1 with each edit."""

    shards: int
    of: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.of):
            out[shard] += weights[slot]
        return out


def plan(weights: list[int], shards: int) -> SlotMap:
    """Heaviest slot first, each to the lightest shard (smaller number on ties)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    heap = [(0, 0, s) for s in range(shards)]
    of = [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
        load, n, shard = heapq.heappop(heap)
        of[slot] = shard
        heapq.heappush(heap, (load + weights[slot], n + 1, shard))
    return SlotMap(shards, of)


def rebalance(old: SlotMap, weights: list[int], shards: int, slack: float = SLACK) -> SlotMap:
    """An edited map for ``shards`` shards.

    Slots of shards that are given up move; then slots move from the heaviest shard to the
    lightest until none is more than ``slack`` above the mean, or no move helps.  All other slots stay.
    """
    of, load = list(old.of), [0] * max(shards, old.shards)
    held: list[list[int]] = [[] for _ in load]
    homeless = []
    for slot, shard in enumerate(of):
        if shard >= shards:
            homeless.append(slot)
        else:
            load[shard] += weights[slot]
            held[shard].append(slot)
    moved = set()

    def move(slot: int, to: int) -> None:
        of[slot] = to
        load[to] += weights[slot]
        held[to].append(slot)
        moved.add(slot)

    for slot in sorted(homeless, key=lambda s: (-weights[s], s)):
        move(slot, min(range(shards), key=lambda s: (load[s], s)))
    for shard in range(shards):
        held[shard].sort(key=lambda s: (weights[s], s))
    most = (1 + slack) * sum(weights) / shards
    while max(load[:shards]) > most:
        high = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fit = [s for s in held[high] if 0 < weights[s] < gap]
        if not fit:
            break
        slot = max(fit, key=lambda s: (min(weights[s], gap - weights[s]), -s))
        held[high].remove(slot)
        load[high] -= weights[slot]
        move(slot, low)
        held[low].sort(key=lambda s: (weights[s], s))
    return SlotMap(shards, of, old.version + 1, sorted(moved))


def save_map(spark: SparkSession, folder: str, plan_: SlotMap) -> str:
    """Store one version; an existing version is never overwritten."""
    path = f"{folder}/version={plan_.version:06d}"
    rows = [(slot, shard) for slot, shard in enumerate(plan_.of)]
    spark.createDataFrame(rows, "vslot int, shard int").withColumn("shards", F.lit(plan_.shards)).coalesce(1).write.mode(
        "error"
    ).parquet(path)
    return path


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version={version:06d}").orderBy("vslot").collect()  # a row a slot
    return SlotMap(rows[0].shards, [r.shard for r in rows], version)


def slot_table(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of every row; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard_by_slots(docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None, grown: int | None = None) -> DataFrame:
    """Every row with its shard, by the law ``bytes``: shards' sizes are nearly equal.

    Takes ``doc_id`` and ``text`` (further columns are not looked at); size is the text's
    UTF-8 bytes plus 16, however long.  A null text counts as empty, a null ``doc_id`` hashes like a value,
    repeated rows each count.  Rows that are equal in id and text share a virtual slot, others
    spread.  ``slot`` numbers a shard's rows from 0 without gaps: virtual slots by number, rows of one by
    (doc_id, crc) but for slots of more than ``SLOT_ROWS`` rows, which are numbered in parts.  An empty table gives no rows.

    The map's first version is stored, and beside it the second: the first edited for ``grown`` shards (one more by default).
    ``folder`` is kept; without it the maps lie in the shared folder until the driver ends.  ``next_shard`` is the
    shard by the second version.
    """
    spark = docs.sparkSession
    table = materialise(slot_table(docs, slots).withColumn("row", F.monotonically_increasing_id()), "slot-table")
    stats = table.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # a row a slot
    weights, counts = [0] * slots, [0] * slots
    for r in stats:
        weights[r.vslot], counts[r.vslot] = r.bytes, r.n
    planned = plan(weights, shards)
    edited = rebalance(planned, weights, grown or shards + 1)
    folder = folder or new_path(spark, "slot-map")
    for version in (planned, edited):
        save_map(spark, folder, version)
    before, offsets = [0] * shards, [0] * slots
    for slot, shard in enumerate(planned.of):
        offsets[slot] = before[shard]
        before[shard] += counts[slot]
    # one row for each used slot: at most ``slots`` rows of 24 bytes, whatever the table's size
    placed = spark.createDataFrame(
        [(s, planned.of[s], edited.of[s], offsets[s], -(-counts[s] // SLOT_ROWS)) for s in range(slots) if counts[s]],
        "vslot int, shard int, next_shard int, first long, parts int",
    )
    rows = table.join(F.broadcast(placed), "vslot").withColumn("part", F.pmod(F.col("row"), F.col("parts")).cast("int"))
    upto = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    order = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "row")
    return (
        rows.withColumn("n", F.row_number().over(order))
        .join(starts.select("vslot", "part", "before"), ["vslot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("before") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "next_shard",
        )
    )
