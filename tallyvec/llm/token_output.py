"""Token-id output: best-fit-decreasing packing with a segment tree, as binary id matrices.

Each task packs its own documents, a bounded number of ids at a time, so ids never cross the network and a lost task
is simply run again. Every row of a matrix is one sequence: its ids (little-endian, 16 bits where the vocabulary allows,
padded with the end id), the cumulative segment lengths, and where positions restart from 0.

Defined results. A null or empty text is one segment, its end id. Overlong documents are cut into capacity-sized pieces,
the first may be shorter; joined in order they are the document again. Ties in length keep the order of reading.
Repeated rows are packed each on its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import prepare, written

CAPACITY = 2048
#: Ids that one task holds and packs together.
WINDOW_IDS = 6_000_000


class CapacityTree:
    """How many open sequences have each free capacity; finds the least free capacity that holds a size in log time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, size: int) -> int | None:
        """The smallest free capacity of at least size that some sequence has."""
        at, count = self.leaves + size, self.count
        if count[at]:
            return size
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indices into lengths."""
    tree, open_at, out = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        free = tree.least(n)
        if free is None:
            free, seq = capacity, len(out)
            out.append([])
        else:
            tree.add(free, -1)
            seq = open_at[free].pop()
        out[seq].append(i)
        if free > n:
            tree.add(free - n, 1)
            open_at[free - n].append(seq)
    return out


def _rows(held: list, capacity: int, first: int, kind: type) -> list[tuple]:
    rows = []
    for k, seq in enumerate(best_fit_decreasing([len(x[3]) for x in held], capacity)):
        row, ends = np.full(capacity, tokens.END, kind), [0]
        for i in seq:
            ids = held[i][3]
            row[ends[-1] : ends[-1] + len(ids)] = ids
            ends.append(ends[-1] + len(ids))
        rows.append((first + k, row.tobytes(), ends, ends[:-1], [held[i][0] for i in seq], [held[i][1] for i in seq], [held[i][2] for i in seq]))
    return rows


def matrices(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window_ids: int = WINDOW_IDS, bits: int = 16) -> DataFrame:
    """One row for each sequence: sequence_id, ids (binary), cu_lengths, position_resets, and doc_ids, pieces, starts of its segments."""
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"sequence_id bigint, ids binary, cu_lengths array<int>, position_resets array<int>, doc_ids array<{kind}>, pieces array<int>, starts array<bigint>"
    unit = {16: np.dtype("<u2"), 32: np.dtype("<u4")}[bits]

    def run(batches):
        done, held, n, into = TaskContext.get().partitionId() << 33, [], 0, None

        def packed():
            rows = _rows(held, capacity, done, unit)
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 2000]), into.types)], schema=into)

        for batch in batches:
            if into is None:
                into = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("cu_lengths", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))])
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = tokens.ids(body.as_py())
                if len(found) and found.max() > np.iinfo(unit).max:
                    raise ValueError(f"id {found.max()} doesn't fit into {bits} bits")
                found = found.astype(unit)
                for k, (s, length) in enumerate(tokens.pieces(len(found), capacity)):
                    held.append((name, k, s, found[s : s + length]))
                n += len(found)
                if n >= window_ids:
                    for out in packed():
                        yield out
                        done += out.num_rows
                    held, n = [], 0
        if held:
            yield from packed()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the matrices as a table with binary rows."""
    matrices(docs, **options).write.option("compression", "zstd").parquet(path)


def segments(packed: DataFrame, bits: int = 16) -> DataFrame:
    """Read the matrices again: doc_id, piece, start, length, ids_crc32 (of 32-bit ids), sequence_id, offset for each segment."""
    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()
    unit = {16: np.dtype("<u2"), 32: np.dtype("<u4")}[bits]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def run(batches):
        for batch in batches:
            sequence, raw, ends, resets = (batch.column(i).to_pylist() for i in range(4))
            seqs, offset, length, crc = [], [], [], []
            for s, body, end, reset in zip(sequence, raw, ends, resets):
                row = np.frombuffer(body, unit).astype("<u4")
                for a, b in zip(reset, end[1:]):
                    seqs.append(s)
                    offset.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(row[a:b].tobytes()))
            flat = [batch.column(i).flatten() for i in (4, 5, 6)]
            yield pa.RecordBatch.from_arrays([*flat, *(pa.array(x, pa.int64()) for x in (length, crc, seqs, offset))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return packed.mapInArrow(run, schema)


def written_segments(docs: DataFrame, **options) -> DataFrame:
    """Pack, write to the shared folder, and give the segments as read from there."""
    return segments(written(matrices(docs, **options), "matrices", "zstd"), options.get("bits", 16))
