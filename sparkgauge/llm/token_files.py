"""Token-ID output in patched frame-of-reference files.

A file holds the ids of documents one after another, cut into blocks of a fixed number of
ids.  Of each block the minimum is subtracted; the differences are packed at the width that
a percentile of them needs, and those that need more stand in the block's exception list.
An index of block starts lets a reader fetch any range of ids without decoding the rest.

Layout (little-endian)::

    "PFORIDS1"
    blocks: u32 minimum, u8 width, u16 exceptions, u16 ids,
            packed bits, u16 positions[exceptions], u32 differences[exceptions]
    index:  u64 block starts[blocks], then per document i64 doc_id, u8 null flag, i64 ids
    footer: u64 index start, u64 blocks, u64 documents, u64 ids, u32 ids a block, "PFORIDS1"

``write_token_files`` orders documents by ``doc_id`` (null first) over the whole table:
file k holds smaller ids than file k+1.  A file is written under a name of its attempt and
then moved to its final name, so a retried or speculative task leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, open_files, partitions
from .encoding import byte_encoder

#: Fixed values of the format.
MAGIC = b"PFORIDS1"
HEAD = struct.Struct("<IBHH")
FOOT = struct.Struct("<QQQQI8s")
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<i8")])

BLOCK_IDS = 16_384
#: The share of a block's differences that its packed width must hold.
WIDTH_PERCENTILE = 0.95


def pack_block(ids: np.ndarray, percentile: float = WIDTH_PERCENTILE) -> bytes:
    """One block of 1 to 65,535 ids below 2^32."""
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    at = min(len(rest) - 1, int(percentile * len(rest)))
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, dtype=np.int64)
    small = rest.copy()
    small[odd] = 0
    if width == 16:
        packed = small.astype(">u2").tobytes()  # what the general way gives, without bits
    elif width:
        lanes = small.astype(">u4").view(np.uint8).reshape(-1, 4)
        bits = np.unpackbits(lanes, axis=1)[:, 32 - width :]
        packed = np.packbits(bits).tobytes()
    else:
        packed = b""
    return (
        HEAD.pack(low, width, len(odd), len(rest))
        + packed
        + odd.astype("<u2").tobytes()
        + rest[odd].astype("<u4").tobytes()
    )


def unpack_block(raw: bytes) -> np.ndarray:
    low, width, odd, n = HEAD.unpack_from(raw)
    at = HEAD.size
    size = (n * width + 7) // 8
    out = np.zeros(n, dtype=np.uint32)
    if width == 16:
        out = np.frombuffer(raw, ">u2", n, at).astype(np.uint32)
    elif width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width).reshape(n, width)
        lanes = np.zeros((n, 32), dtype=np.uint8)
        lanes[:, 32 - width :] = bits
        out = np.packbits(lanes, axis=1).view(">u4").ravel().astype(np.uint32)
    at += size
    if odd:
        out[np.frombuffer(raw, "<u2", odd, at)] = np.frombuffer(raw, "<u4", odd, at + 2 * odd)
    return out + np.uint32(low)


class TokenWriter:
    """Streams documents into one file; holds one block of ids and 17 bytes a document."""

    def __init__(self, sink, block_ids: int = BLOCK_IDS, percentile: float = WIDTH_PERCENTILE):
        self.sink, self.block_ids, self.percentile = sink, block_ids, percentile
        self.at, self.ids = len(MAGIC), 0
        self.starts: list[int] = []
        self.documents: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        if self.n_held >= 4 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        stream = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(stream) if last else len(stream) // self.block_ids * self.block_ids
        for at in range(0, end, self.block_ids):
            raw = pack_block(stream[at : min(end, at + self.block_ids)], self.percentile)
            self.starts.append(self.at)
            self.sink.write(raw)
            self.at += len(raw)
        self.held, self.n_held = [stream[end:]], len(stream) - end

    def close(self) -> None:
        self._flush(True)
        self.sink.write(np.asarray(self.starts, dtype="<u8").tobytes())
        self.sink.write(np.array(self.documents, dtype=DOCUMENT).tobytes())
        self.sink.write(FOOT.pack(self.at, len(self.starts), len(self.documents), self.ids, self.block_ids, MAGIC))


class TokenReader:
    """Random access to one file through its index."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - FOOT.size)
        self.index, n_blocks, n_docs, self.ids, self.block_ids, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(self.index)
        self.starts = np.append(np.frombuffer(source.read(8 * n_blocks), "<u8"), np.uint64(self.index))
        self.documents = np.frombuffer(source.read(DOCUMENT.itemsize * n_docs), DOCUMENT)
        self.first = np.append(0, np.cumsum(self.documents["n"]))
        self.block = (-1, np.empty(0, np.uint32))

    def _block(self, k: int) -> np.ndarray:
        if self.block[0] != k:
            begin, end = int(self.starts[k]), int(self.starts[k + 1])
            self.source.seek(begin)
            self.block = (k, unpack_block(self.source.read(end - begin)))
        return self.block[1]

    def read(self, begin: int, n: int) -> Iterator[np.ndarray]:
        """ids ``begin`` to ``begin + n`` of the file, block by block."""
        while n > 0:
            k, at = divmod(begin, self.block_ids)
            part = self._block(k)[at : at + n]
            yield part
            begin += len(part)
            n -= len(part)

    def document(self, i: int) -> np.ndarray:
        return np.concatenate([*self.read(int(self.first[i]), int(self.documents["n"][i])), np.empty(0, np.uint32)])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS,
                      percentile: float = WIDTH_PERCENTILE, files: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write ids in ascending ``doc_id`` order.

    Takes ``doc_id`` and ``text`` of ``docs`` (further columns are not looked at).  Null text
    counts as empty, a long one is encoded whole; a null ``doc_id`` comes first; rows of one id follow each other in the order of
    their texts' hashes and may lie in several files.  Returns the manifest, one row a file: ``file`` (number), ``path``, ``documents``,
    ``ids``, ``first_id`` (ids in all files before).  An empty table gives an empty manifest.

    ``folder`` (new or empty, on a store that all executors reach) is kept, with the manifest in its ``manifest``, which
    ``read_manifest`` opens; without it the files lie in the shared folder until the driver ends.
    """
    spark = docs.sparkSession
    kept = folder is not None
    folder = folder.rstrip("/") if kept else new_path(spark, "token-files")
    if kept:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(place)
        if len(store.listStatus(place)):
            raise FileExistsError(f"{folder} is not empty")
        folder = store.makeQualified(place).toString()
    parts = files or partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = byte_encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32).tobytes()
        number = TaskContext.get().partitionId()
        writer = None
        store, top = open_files(folder)
        final = f"{top}/part-{number:06d}.ids"
        own = f"{top}/.{number:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = store.open_output_stream(own)
                writer = TokenWriter(sink, block_ids, percentile)
            names, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, batch.num_rows, 256):
                for name, raw in zip(names[at : at + 256], encoder.encode(column.slice(at, 256).to_pylist()), strict=True):
                    writer.add(name, np.frombuffer(raw + end, np.uint32))
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, final)
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([number], pa.int32()), "path": [f"{folder}/part-{number:06d}.ids"],
                 "documents": pa.array([len(writer.documents)], pa.int64()), "ids": pa.array([writer.ids], pa.int64())}
            )

    # the hash splits an id that very many rows share
    order = (F.col("doc_id").asc_nulls_first(), F.col("hash"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(write, "file int, path string, documents long, ids long")
        .collect()  # one row a file
    )
    manifest, first = [], 0
    for r in sorted(rows, key=lambda r: r.file):
        manifest.append((r.file, r.path, r.documents, r.ids, first))
        first += r.ids
    out = spark.createDataFrame(manifest, MANIFEST)
    if kept:
        out.coalesce(1).write.parquet(f"{folder}/manifest")  # a row a file
    return out


#: The manifest's columns.
MANIFEST = "file int, path string, documents long, ids long, first_id long"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a kept folder, by whatever process."""
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``
    (of its ids as little-endian unsigned 32-bit integers), read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_files(row["path"])
                with store.open_input_file(path) as source:
                    reader = TokenReader(source)
                    crc = np.zeros(len(reader.documents), dtype=np.int64)
                    for i, (begin, n) in enumerate(zip(reader.first.tolist(), reader.documents["n"].tolist(), strict=False)):
                        x = 0
                        for part in reader.read(begin, n):
                            x = zlib.crc32(part.astype("<u4", copy=False), x)
                        crc[i] = x
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(reader.documents["doc_id"], pa.int64(), mask=reader.documents["null"].astype(bool)),
                        "start": pa.array(reader.first[:-1] + row["first_id"], pa.int64()),
                        "n_tokens": pa.array(reader.documents["n"].astype(np.int64), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    # a file a task; the number of rows is that of files
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
