"""Best-fit packing of documents' token pieces into sequences, over the whole corpus.

Documents and gaps are range-sorted by size. In each bulk-synchronous round every unplaced document looks for its
successor, the smallest gap that holds it; longer documents rank first where several want one gap; the gaps shrink and
the next round begins. Sizes are whole numbers up to the capacity, so sorted documents and gaps are runs of equal size,
and a sweep works on runs: a run of documents meets a run of gaps, and ranks within the runs say which document goes
where. There are never more document runs than the capacity; the sorting and ranking of the documents themselves, and
the placing, are Spark jobs over all partitions.

Defined results. A null or empty text is one piece, its end id. Ties in length go by document and piece. Repeated
rows are placed each on its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import prepare, written

CAPACITY = 2048


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, body in enumerate(batch.column(1)):
                ids = tokens.ids(body.as_py())
                for k, (s, n) in enumerate(tokens.pieces(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(sizes: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements of runs: (size, first rank, past rank, first sequence, documents of the run in each sequence, offset).

    sizes: how many documents have each size. A run's k-th document by rank goes to sequence first + k // each, at
    offset + size * (k % each).
    """
    waiting = {s: [0, n] for s, n in sizes.items() if n}  # next rank, count
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences, first and past
    free = 0
    out = []

    def place(size: int, first: int, past: int, gap: int, most: int) -> int:
        """Up to most documents of this size into these sequences, each as full as it gets; how many were placed."""
        each = gap // size
        rank = waiting[size][0]
        took = min(most, each * (past - first))
        full, rest = divmod(took, each)
        if full:
            out.append((size, rank, rank + full * each, first, each, capacity - gap))
            if gap - each * size:
                gaps.setdefault(gap - each * size, []).append((first, first + full))
        if rest:
            out.append((size, rank + full * each, rank + took, first + full, rest, capacity - gap))
            gaps.setdefault(gap - rest * size, []).append((first + full, first + full + 1))
        if (kept := first + full + bool(rest)) < past:
            gaps.setdefault(gap, []).append((kept, past))
        waiting[size] = [rank + took, past_of[size] - rank - took]
        return took

    past_of = {s: n for s, (_, n) in waiting.items()}
    while any(n for _, n in waiting.values()):
        # sweep: from the longest on, each run of documents takes its successor among the gaps as they were when the round began
        order, moved = sorted(gaps), False
        opened = {g: gaps[g] for g in order}
        gaps.clear()
        for size in sorted((s for s, (_, n) in waiting.items() if n), reverse=True):
            while waiting[size][1] and (at := bisect.bisect_left(order, size)) < len(order):
                gap = order[at]
                first, past = opened[gap].pop()
                if not opened[gap]:
                    order.pop(at)
                place(size, first, past, gap, waiting[size][1])
                moved = True
            if waiting[size][1] and not any(g >= size for g in gaps):
                # no gap of this round or the next holds it: new sequences, as full as this size makes them
                each = capacity // size
                need = -(-waiting[size][1] // each)
                place(size, free, free + need, capacity, waiting[size][1])
                free += need
                moved = True
        for g in order:
            gaps.setdefault(g, []).extend(opened[g])
        assert moved
    return out


def pack(parts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """parts, with their columns and sequence_id and offset; length gives the size of each, at most capacity.

    Recovers from lost executors: the sorted pieces are a written table, and all ranks are read from it.
    """
    spark = parts.sparkSession
    order = [c for c in ("length", "doc_id", "piece") if c in parts.columns]
    ranked = parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranked = written(ranked, "pieces")
    # one row for each partition and size in it; sizes don't interleave between sorted partitions, so there are at most partitions + capacity of them
    counts = ranked.groupBy(F.shiftright("_place", 33).alias("p"), "length").agg(F.count("*").alias("n")).collect()
    sizes: dict[int, int] = {}
    by_part: dict[int, int] = {}
    for r in counts:
        sizes[r.length] = sizes.get(r.length, 0) + r.n
        by_part[r.p] = by_part.get(r.p, 0) + r.n
    if not sizes:
        return ranked.drop("_place").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    before, at = {}, 0
    for p in sorted(by_part):
        before[p] = at
        at += by_part[p]
    start, at = {}, 0
    for s in sorted(sizes):
        start[s] = at
        at += sizes[s]
    runs = sorted((start[s] + a, s, first, each, offset) for s, a, _, first, each, offset in plan(sizes, capacity))
    held = spark.sparkContext.broadcast((before, *(np.array(x, np.int64) for x in zip(*runs))))
    cols = ranked.drop("_place").columns
    schema = ranked.drop("_place").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema

    def run(batches):
        before, begin, size, first, each, offset = held.value
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy()
            rank = (place & ((1 << 33) - 1)) + np.array([before[p] for p in (place >> 33).tolist()], np.int64)
            r = np.searchsorted(begin, rank, side="right") - 1
            k = rank - begin[r]
            sequence, within = first[r] + k // each[r], offset[r] + size[r] * (k % each[r])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(sequence), pa.array(within)], names=[*cols, "sequence_id", "offset"])

    return ranked.select(*cols, "_place").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(pieces(docs, doc_id=doc_id, text=text, capacity=capacity), capacity=capacity)


