"""Near duplicates by SimHash, linked through a generalised pigeonhole index.

The 64 bits are grouped into m parts, correlated bits together.  If two fingerprints differ
in at most R bits and thresholds t(1)..t(m) sum to R - m + 1, they differ in at most t(i) bits of
some part i.  The thresholds may be unequal, and differ from one fingerprint to the next:
a part whose value is common gets -1 (it is not looked at), and rare parts more.  A dynamic
program picks, for each fingerprint, the thresholds with the fewest estimated candidates, from counts of
part values.  Every fingerprint is indexed under its m part values and probes all values within its
thresholds; candidates are verified on all 64 bits.

A link may also have to hold on 64 further bits of the same texts (``more``), which keeps chance apart from likeness where the
radius is wide: of two unrelated texts 3.8e-11 are within 7 of 64 bits, and a 4,000th of those within 18 of the other 64.

Only distinct fingerprints are linked.  Large buckets are split into blocks that meet each
other block by block, and a task passes on a forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructField, StructType, VariantType

from .common import materialise, partitions
from .components import connected_components, forest

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: What counts as a near copy where one document of each group is kept: shingles of five words, so many of 64 bits and of 64 further ones.
NEAR_WORDS = 5
NEAR_RADIUS = 7
NEAR_CHECK = 18
#: The largest threshold tried for one part.
MAX_THRESHOLD = 2
#: Values of a part are counted in 2^COUNT_BITS cells (by their low bits, and by their hash), so counts have a fixed size.
COUNT_BITS = 12
#: Fingerprints of a block in a large bucket.
BLOCK = 2048
#: Candidate pairs verified at once.
SLAB = 2_000_000
#: The cost of a probe, which is sorted and sent, in candidates.
PROBE_COST = 32.0


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of one text; 0 without words."""
    return int(_fingerprints([text], words)[0][0])


def _fingerprints(texts: list[str | None], shingle: int = SHINGLE_WORDS, seeds: tuple = (SEED,)) -> list[np.ndarray]:
    """For each seed the fingerprints of the texts."""
    from xxhash import xxh64_intdigest

    joined = b" ".join([b"%b"] * shingle)
    hashes: list[list[int]] = [[] for _ in seeds]
    ends = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        # bytes.lower changes A-Z only, bytes.split splits at [\x20\x09-\x0D]
        words = text.encode().lower().split() if text else []
        if len(words) >= shingle:
            runs = [joined % x for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
        else:
            runs = [b" ".join(words)] if words else []
        for out, seed in zip(hashes, seeds, strict=True):
            out += [xxh64_intdigest(x, seed) for x in runs]
        ends[i] = len(hashes[0])
    return [_majority(np.array(h, dtype="<u8"), ends) for h in hashes]


def _majority(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bits set in over half the hashes of each text, whose hashes end at ``ends``."""
    out = np.zeros(len(ends), dtype=np.uint64)
    begin = 0
    for i, end in enumerate(ends.tolist()):
        if end > begin:
            ones = np.zeros(BITS, dtype=np.int64)
            for at in range(begin, end, 1 << 16):
                bits = np.unpackbits(h[at : min(end, at + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.uint32)
            out[i] = np.packbits(2 * ones > end - begin, bitorder="little").view("<u8")[0]
        begin = end
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, check: bool = False) -> DataFrame:
    """``docs`` (with a column ``text``) with ``fp`` and ``more``, 64 bits as a signed long each, in place of ``text``.

    ``more`` is 0 unless ``check``."""
    names = [c for c in docs.columns if c != "text"]
    seeds = (SEED, SEED + 1) if check else (SEED,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for at in range(0, batch.num_rows, 128):
                fp, *more = _fingerprints(column.slice(at, 128).to_pylist(), words, seeds)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, 128) for c in names), pa.array(fp.view(np.int64)), pa.array((more[0] if more else np.zeros_like(fp)).view(np.int64))],
                    names=[*names, "fp", "more"],
                )

    schema = StructType([*(docs.schema[c] for c in names), StructField("fp", LongType()), StructField("more", LongType())])
    return docs.mapInArrow(run, schema)


def part_count(n: int, radius: int = RADIUS) -> int:
    """Parts for n fingerprints: the number with the least estimated cost of probes and candidates."""

    def cost(m: int) -> float:
        width, (low, more) = BITS / m, divmod(radius - m + 1, m)
        probes = sum(comb(int(width), i) for j in range(m) for i in range(low + (j < more) + 1))
        return probes * (PROBE_COST + n / 2.0**width)

    return min((m for m in range(2, radius + 2) if radius - m + 1 <= m * MAX_THRESHOLD), key=cost) if radius else 1


def group_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; ``together``: absolute correlations.

    A group starts with the free bit that is most correlated with others and takes, again
    and again, the free bit most correlated with the group.
    """
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        group = [max(free, key=lambda b: (sum(together[b, c] for c in free if c != b), -b))]
        free.remove(group[0])
        while len(group) < size:
            bit = max(free, key=lambda b: (sum(together[b, c] for c in group), -b))
            group.append(bit)
            free.remove(bit)
        out.append(sorted(group))
    return out


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(parts, n): the bits of each group as a number."""
    fp = fp.view(np.uint64)
    out = np.zeros((len(groups), len(fp)), dtype=np.uint64)
    for i, bits in enumerate(groups):
        for j, b in enumerate(bits):
            out[i] |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def masks(width: int, most: int) -> list[np.ndarray]:
    """For t = 0..most all words of ``width`` bits with exactly t ones."""
    return [
        np.array([sum(1 << b for b in c) for c in combinations(range(width), t)], dtype=np.uint64) for t in range(most + 1)
    ]


def estimates(counts: np.ndarray, width: int) -> np.ndarray:
    """(thresholds 0..MAX, cells): estimated candidates of a value from counts by its low bits."""
    spread = 2.0 ** max(0, width - COUNT_BITS)
    cells = np.arange(len(counts), dtype=np.int64)
    low = min(width, COUNT_BITS)
    rings = [counts.astype(np.float64)]
    one = sum(counts[cells ^ (1 << b)] for b in range(low)) + (width - low) * counts
    rings.append(one.astype(np.float64))
    # each value at distance 2 is reached twice from distance 1
    two = (sum(one[cells ^ (1 << b)] for b in range(low)) + (width - low) * one - width * counts) / 2
    rings.append(two.astype(np.float64))
    return np.cumsum(rings, axis=0) / spread


def allocate(values: np.ndarray, tables: list[np.ndarray], widths: list[int], radius: int = RADIUS) -> np.ndarray:
    """(parts, n) thresholds of -1 to MAX_THRESHOLD that sum to radius - parts + 1, of least cost."""
    m, n = values.shape
    want = radius - m + 1
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(n), np.zeros((0, n), dtype=np.int8))}
    for i in range(m):
        cell = (values[i] & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)
        cost = {-1: np.zeros(n)}
        for t in range(MAX_THRESHOLD + 1):
            cost[t] = tables[i][t][cell] + PROBE_COST * sum(comb(widths[i], j) for j in range(t + 1))
        new: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s, (sofar, chosen) in best.items():
            for t, c in cost.items():
                left = m - i - 1
                if not -left <= want - s - t <= left * MAX_THRESHOLD:
                    continue
                total, path = sofar + c, np.vstack([chosen, np.full((1, n), t, dtype=np.int8)])
                if s + t in new:
                    old, old_path = new[s + t]
                    better = total < old
                    new[s + t] = (np.where(better, total, old), np.where(better, path, old_path))
                else:
                    new[s + t] = (total, path)
        best = new
    return best[want][1]


def _statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the absolute correlations of their bits."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                both += bits[at : at + (1 << 16)].T @ bits[at : at + (1 << 16)]
            n += len(fp)
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), "value": pa.array(np.append(both.ravel(), n)),
        })

    rows = nodes.select("fp").mapInArrow(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    flat = np.zeros(BITS * BITS + 1)
    for r in rows.collect():  # 4,097 rows at any size
        flat[r.cell] = r.value
    n, both = int(flat[-1]), flat[:-1].reshape(BITS, BITS)
    if not n:
        return 0, np.zeros((BITS, BITS))
    mean = np.diag(both) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return n, np.abs(both / n - np.outer(mean, mean)) / np.outer(spread, spread)


def _hashed(value: np.ndarray) -> np.ndarray:
    """The cell of a whole part value."""
    return (((value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def block_counts(counts: np.ndarray, width: int) -> np.ndarray:
    """Blocks of the buckets in each hashed cell, from the fingerprints of the cell.

    A cell holds 2^(width - COUNT_BITS) values, of which most are empty or small where parts are wide; what it has beyond the
    mean and its noise must come from a common value, which has a bucket of so many.
    """
    mean = counts.sum() / len(counts)
    spread = 2.0 ** max(0, width - COUNT_BITS)
    largest = counts if spread == 1 else np.maximum(counts / spread, counts - mean - 4 * np.sqrt(mean))
    return np.maximum(1, -(-largest // BLOCK)).astype(np.int64)


def _counts(nodes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Fingerprints by the low bits of each part's value, then by the hash of each part's value: at most 4,096 numbers each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * len(groups), 1 << COUNT_BITS), dtype=np.int64)
        for batch in batches:
            values = part_values(batch.column("fp").to_numpy(zero_copy_only=False), groups)
            for i in range(len(groups)):
                np.add.at(total[i], (values[i] & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64), 1)
                np.add.at(total[len(groups) + i], _hashed(values[i]), 1)
        part, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(part * (1 << COUNT_BITS) + cell), "n": pa.array(total[part, cell])})

    rows = nodes.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(2 * len(groups) << COUNT_BITS, dtype=np.int64)
    flat[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return list(flat.reshape(2 * len(groups), -1))


def _dealt(nodes: DataFrame, groups: list[list[int]], counts: list[np.ndarray], radius: int) -> DataFrame:
    """Index entries and probes: ``key`` (part and value), blocks ``a`` and ``b``, ``probe``, ``fp``, ``more``."""
    widths = [len(g) for g in groups]
    low, hashed = counts[: len(groups)], counts[len(groups) :]
    send = nodes.sparkSession.sparkContext.broadcast((
        low, [estimates(c, w) for c, w in zip(low, widths, strict=True)], [block_counts(c, w) for c, w in zip(hashed, widths, strict=True)]
    ))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tables, cut = send.value
        flips = [masks(w, MAX_THRESHOLD) for w in widths]

        def rows(part: int, value: np.ndarray, fp: np.ndarray, more: np.ndarray, probe: bool) -> Iterator[pa.RecordBatch]:
            # a bucket of more than BLOCK entries is cut into blocks of entries (a) and of probes (b)
            blocks = cut[part][_hashed(value)]
            if probe:
                some = counts[part][(value & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)] > 0
                value, fp, more, blocks = value[some], fp[some], more[some], blocks[some]
            own = ((fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % blocks
            again = np.repeat(np.arange(len(fp)), blocks)
            other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            a, b = (other, own[again]) if probe else (own[again], other)
            key = (np.uint64(part) << np.uint64(56)) | value
            for at in range(0, len(again), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key[again[s]].view(np.int64)), "a": pa.array(a[s].astype(np.int32)), "b": pa.array(b[s].astype(np.int32)),
                    "probe": pa.array(np.full(len(again[s]), probe)), "fp": pa.array(fp[again[s]]), "more": pa.array(more[again[s]]),
                })

        for batch in batches:
            every, other = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "more"))
            for start in range(0, len(every), 20_000):
                fp, more = every[start : start + 20_000], other[start : start + 20_000]
                values = part_values(fp, groups)
                chosen = allocate(values, tables, widths, radius)
                for i in range(len(groups)):
                    yield from rows(i, values[i], fp, more, False)
                    for t in range(MAX_THRESHOLD + 1):
                        who = chosen[i] >= t
                        if who.any():
                            flip = flips[i][t]
                            yield from rows(i, (values[i][who][:, None] ^ flip).ravel(), np.repeat(fp[who], len(flip)), np.repeat(more[who], len(flip)), True)

    return nodes.select("fp", "more").mapInArrow(deal, "key long, a int, b int, probe boolean, fp long, more long")


def _verify(radius: int, check: int):
    """Links of sorted buckets, as a forest: the function for mapInArrow."""

    def pairs(group: np.ndarray, probe: np.ndarray, fp: np.ndarray, more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # rows are sorted by (group, probe): entries first
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(group)))
        probes = np.add.reduceat(probe.astype(np.int64), starts)
        entries = sizes - probes
        some = (probes > 0) & (entries > 0)
        starts, probes, entries = starts[some], probes[some], entries[some]
        work = probes * entries
        at = 0
        while at < len(work):
            to = max(at + 1, int(np.searchsorted(np.cumsum(work[at:]), SLAB, side="right")) + at)
            total = work[at:to]
            for low in range(0, int(total.sum()), SLAB):
                high = min(int(total.sum()), low + SLAB)
                n = np.arange(low, high)
                before = np.cumsum(total) - total
                g = np.searchsorted(before, n, side="right") - 1
                n -= before[g]
                i = starts[at:to][g] + n // probes[at:to][g]
                q = starts[at:to][g] + entries[at:to][g] + n % probes[at:to][g]
                # a probe finds all its neighbours, so the larger of two needs no look back
                linked = (fp[i] > fp[q]) & (np.bitwise_count((fp[i] ^ fp[q]).view(np.uint64)) <= radius)
                i, q = i[linked], q[linked]
                both = np.bitwise_count((more[i] ^ more[q]).view(np.uint64)) <= check
                if both.any():
                    yield fp[i[both]], fp[q[both]]
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "a", "b", "probe", "fp", "more")
        held: list[list[np.ndarray]] = []
        n_held = 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n_found = 0

        def settle(rows: list[np.ndarray]) -> None:
            nonlocal found, n_found
            key, a, b, probe, fp, more = rows
            new = np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            for x in pairs(np.cumsum(new), probe, fp, more):
                found.append(x)
                n_found += len(x[0])
                if n_found > 4 * SLAB:
                    found = [forest(*(np.concatenate(c) for c in zip(*found, strict=True)))]
                    n_found = len(found[0][0])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            n_held += batch.num_rows
            if n_held < 200_000:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            key, a, b = rows[:3]
            # the last bucket may go on in the next batch
            same = (key == key[-1]) & (a == a[-1]) & (b == b[-1])
            cut = int(np.argmax(same))
            if cut:
                settle([c[:cut] for c in rows])
            held = [[c[cut:] for c in rows]]
            n_held = len(held[0][0])
        if held:
            settle([np.concatenate(c) for c in zip(*held, strict=True)])
        if found:
            a, b = forest(*(np.concatenate(c) for c in zip(*found, strict=True)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    return run


def link(nodes: DataFrame, radius: int = RADIUS, check: int = BITS) -> DataFrame:
    """Edges ``a, b`` with the components of all pairs of ``nodes`` (distinct ``fp``, and ``more``) that differ in at most
    ``radius`` bits of ``fp`` and ``check`` of ``more``.  Tasks give forests, so there are fewer edges than links."""
    n, together = _statistics(nodes)
    spark = nodes.sparkSession
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    groups = group_bits(together, part_count(n, radius))
    dealt = _dealt(nodes, groups, _counts(nodes, groups), radius)
    parts = partitions(spark)
    return (
        dealt.repartition(parts, "key", "a", "b")
        .sortWithinPartitions("key", "a", "b", "probe")
        .mapInArrow(_verify(radius, check), "a long, b long")
    )


def components_of(prints: DataFrame, radius: int = RADIUS, check: int = BITS) -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint of ``prints`` (doc_id, fp, more).

    Texts of one fingerprint are taken for one; ``more`` is then the smallest of theirs."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("more").alias("more")), "distinct-fingerprints")
    roots = connected_components(link(nodes, radius, check)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "placed")
    # written before the join, so that both sides come straight from a shuffle and Spark can split a giant component
    least = materialise(placed.groupBy("root").agg(F.min("low").alias("component_id")), "least-ids")
    return placed.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Takes ``doc_id`` and ``text`` (further columns are not looked at).  Null, empty and blank
    texts have fingerprint zero and are linked like any other; texts of fewer words than a shingle have one
    shingle, all of them; a text is read whole, however long.
    ``component_id`` is the smallest ``doc_id`` of the component (null only if all its ids are
    null); repeated rows each give a row.  An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "fingerprints")
    named = components_of(prints, radius).select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _hashable(field: StructField) -> list:
    """Columns to hash for one of the table's: its values as text where it has a nested type, and where it is null."""
    c = F.col(f"`{field.name}`")
    return [F.to_json(F.struct(c)) if isinstance(field.dataType, ArrayType | MapType | StructType | VariantType) else c, c.isNull()]


def keep_one(docs: DataFrame, radius: int = NEAR_RADIUS, words: int = NEAR_WORDS, check: int = NEAR_CHECK) -> DataFrame:
    """``docs`` with one row of each component, all its columns as they are: that of the smallest ``doc_id``.

    Of rows that share this id the one with the smallest digest stays, one of those that are equal in all columns.  A row
    without a ``doc_id`` stays only where its whole component has none.  Null, empty and blank texts are one component;
    an empty table gives no rows.
    """
    digest = F.xxhash64(*[c for f in docs.schema for c in _hashable(f)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"))
    prints = materialise(fingerprints(rows.drop("row"), words, check < BITS), "fingerprints")
    kept = components_of(prints, radius, check)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    stays = materialise(prints.join(kept.select("fp", "root"), "fp").groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.digest"), "kept")
    found = rows.drop("text").join(
        stays.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left_semi"
    )
    if not prints.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        # some rows are equal in all columns: of these one stays; no other row shares its key, so none is lost
        found = found.groupBy("doc_id", "digest").agg(F.first("row").alias("row"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
