"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

A document's ids end with ``end_id``. Its full windows of ``capacity`` ids become sequences of their
own; what is left is cut into pieces of at most ``piece`` ids. Pieces gather until they fill
``WINDOWS`` windows, then differencing spreads them: each piece starts as a partial partition, and
the two partitions with the greatest imbalance merge, fullest window to emptiest, until one is left.
If a window exceeds the capacity, the number of windows rises by one and the pieces are spread anew.
Packing runs inside each partition: no shuffle, memory bounded by one document and WINDOWS windows.
Sequence ids are the partition's number and a counter: the same when a lost task is run again.

Defined results: null or empty text is the end id alone. Very long texts fill windows of their own, in
memory in proportion to the longest one. Repeated rows are packed each on its own, an empty table gives
no pieces. Pieces of equal length are taken in their order. Columns beside doc_id and text are ignored,
whatever their names. The same input partitions give the same sequences. Whatever the last windows of a partition hold, pieces lie gapless from offset 0 in every sequence.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.bpe import encoder, vocabulary
from lodestar.llm.common import SLICE_ROWS

#: Windows that are spread at once; the longest piece of what full windows leave.
WINDOWS, PIECE = 128, 256


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of item numbers with near-equal sums.

    A partial partition is a list of (sum, items) from the fullest window down; windows not in the
    list are empty. Items hang in nested pairs until the end, so a merge costs its windows alone.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k  # so many windows of a get one of b
        if over > 0:
            # the fullest of b goes to the emptiest of a
            both = [(x + y, (p, q)) for (x, p), (y, q) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
            merged = a[: len(a) - over] + b[: len(b) - over] + both
        else:
            merged = a + b
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], tie, merged))
        tie += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            todo.extend(x) if isinstance(x, tuple) else items.append(x)
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of item numbers, none above the capacity; their number rises until that holds."""
    k = -(-sum(sizes) // capacity)
    while k:
        groups = differencing(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return groups
        k += 1
    return []


FIELDS = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 0, piece: int = PIECE, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``with_ids``
    adds the piece's ids as little-endian unsigned 32-bit binary."""
    from pyspark.sql.pandas.types import to_arrow_schema

    path = path or vocabulary()
    schema = T.StructType([docs.schema["doc_id"], *FIELDS, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        end = np.array([end_id], dtype="<u4")
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        made = 0
        rows: list[tuple] = []
        pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        held = 0

        def put(doc, start: int, ids: np.ndarray, total: int, offset: int) -> None:
            raw = ids.tobytes()
            rows.append((doc, start, len(ids), zlib.crc32(raw), total, first + made, offset, *([raw] if with_ids else [])))

        def spread() -> None:
            nonlocal made, held
            for group in windows([len(x[2]) for x in pool], capacity):
                offset = 0
                for i in sorted(group):
                    doc, start, ids, total = pool[i]
                    put(doc, start, ids, total, offset)
                    offset += len(ids)
                made += 1
            pool.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)
            rows.clear()
            return batch

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([encode(text or ""), end])
                    total = len(ids)
                    full = total - total % capacity
                    for start in range(0, full, capacity):
                        put(doc, start, ids[start : start + capacity], total, 0)
                        made += 1
                    for start in range(full, total, piece):
                        pool.append((doc, start, ids[start : start + piece].copy(), total))
                    held += total - full
                    if held >= WINDOWS * capacity:
                        spread()
                if len(rows) >= 2048:
                    yield flush()
        if pool:
            spread()
        if rows:
            yield flush()

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
