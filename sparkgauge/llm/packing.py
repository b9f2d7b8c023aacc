"""Packing documents into training sequences by harmonic classes.

A piece of length in (C/(k+1), C/k], C the capacity, belongs to class k; a bin of class k takes exactly k
pieces.  Documents may be cut, so pieces longer than C/8 are cut to the exact size C/k of a
class, whose bins then have no gap; what remains (at most C/8 ids) goes whole into its class, whose
bins lose less than 1/(k+1) of their room.  Every worker fills bins of its own and
no row moves between workers: there is no shuffle, and nothing is held but open bins.

At its end a worker has at most one open bin a class.  Their pieces are laid one after the
other and cut at C; the last run of fewer than C ids is cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import word_encoder

CAPACITY = 4096
#: Pieces longer than capacity / CUT_CLASS are cut to the exact size of a class.
CUT_CLASS = 8
#: Sequence numbers of one worker; its partition number stands above them.
WORKER_BITS = 40


def cut_lengths(n: int, capacity: int = CAPACITY, cut_class: int = CUT_CLASS) -> list[int]:
    """Lengths of a document's pieces, in order; they sum to n."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n * cut_class > capacity:
        k = -(-capacity // n)  # the smallest class whose exact size is n at most
        out.append(capacity // k)
        n -= capacity // k
    return [*out, n] if n else out


class HarmonicPacker:
    """Packs pieces of documents; gives (payload, start, length, sequence, offset).

    ``payload_of(document, start, length)`` is what an open bin holds of a piece: by default
    the document itself.
    """

    def __init__(self, capacity: int = CAPACITY, cut_class: int = CUT_CLASS, first: int = 0,
                 payload_of=lambda document, start, length: document):
        self.capacity, self.cut_class, self.next, self.payload_of = capacity, cut_class, first, payload_of
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield (*piece, self.next, at)
            at += piece[2]
        self.next += 1

    def add(self, document, n: int) -> Iterator[tuple]:
        start = 0
        for length in cut_lengths(n, self.capacity, self.cut_class):
            k = self.capacity // length
            held = self.open.setdefault(k, [])
            held.append((self.payload_of(document, start, length), start, length))
            start += length
            if len(held) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """The pieces of open bins, cut where a sequence is full."""
        run = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(p[2] for p in run)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            bin_: list[tuple] = []
            while room:
                document, start, length = run.pop(0)
                take = min(room, length)
                bin_.append((document, start, take))
                if take < length:
                    run.insert(0, (document, start + take, length - take))
                room -= take
            yield from self._close(bin_)


def harmonic_pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
                  cut_class: int = CUT_CLASS) -> DataFrame:
    """Tokenise and pack; one row per piece.

    Takes ``doc_id`` and ``text`` (further columns are not looked at).  Null text counts as
    empty, so every document has its end id at least; a null or repeated ``doc_id`` is carried
    as it is, each row a document of its own.  An empty table gives no rows.  Returns
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32).tobytes()
        # an open bin holds the ids of its own pieces, not those of whole documents
        packer = HarmonicPacker(
            capacity, cut_class, TaskContext.get().partitionId() << WORKER_BITS,
            lambda d, start, length: (d[0], d[1][4 * start : 4 * (start + length)], start, len(d[1]) // 4),
        )

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for (name, raw, base, total), start, length, sequence, offset in rows:
                crc = zlib.crc32(memoryview(raw)[4 * (start - base) : 4 * (start - base + length)])
                out.append((name, start, length, crc, total, sequence, offset))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        for batch in batches:
            names, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for name, raw in zip(names[at : at + 256], encoder.encode(column.slice(at, 256).to_pylist()), strict=True):
                    raw += end
                    rows += packer.add((name, raw), len(raw) // 4)
                if rows:
                    yield batch_of(rows)
        if rows := list(packer.finish()):
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        pack, ", ".join(f"{c} long" for c in NAMES)
    )


#: The result's columns, in order.
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
