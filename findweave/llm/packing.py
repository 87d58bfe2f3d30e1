"""Packing: Karmarkar-Karp multiway differencing.

Documents are cut into pieces of at most ``PIECE`` tokens, but for full windows, which stay whole and
are sequences of their own. The pieces of a group of documents start as partial partitions of one
piece each; the two partitions with the largest imbalance are merged again and again, the fullest
windows of one with the emptiest of the other, until one partition with near-equal windows is left.
If a window of it exceeds the capacity, the number of windows rises and the group is packed anew.

A group is closed when its pieces fill ``GROUP`` windows but for ``SPARE`` tokens in each, the room
that differencing needs; the piece that crosses this mark is cut there and goes on in the next
group. Groups are formed of neighbouring documents of one input partition, so nothing is shuffled,
memory is bounded, and a lost task packs the same pieces again.

Defined results: a null or empty text is the end id alone; repeated rows are packed each, pieces of
equal size in the order of their rows; an empty table has no pieces; other columns never take part.
Very long texts fill windows of their own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from findweave.llm import _tokens
from findweave.llm._blocks import narrow, texts_of

WINDOW = 2048
END_ID = 1
#: Tokens of a piece at most that is not a window of its own.
PIECE = 256
#: Windows that are packed together, and tokens that stay free in each on average.
GROUP, SPARE = 64, 16
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Split the items (by number) into ``k`` lists with near-equal sums of ``sizes``.

    A merge only notes how it ordered its windows; the items are followed back to their window
    when one partition is left.
    """
    n = len(sizes)
    partitions = np.zeros((n, k), np.int64)  # ascending; the smallest is kept at 0
    partitions[:, -1] = sizes if k > 1 else 0
    held, merges = list(partitions), []
    heap = [(-int(s[-1]), i) for i, s in enumerate(held)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        sums = held[a] + held[b][::-1]
        order = sums.argsort(kind="stable")
        sums = sums[order]
        sums -= sums[0]
        held[a] = held[b] = None
        heapq.heappush(heap, (-int(sums[-1]), n + len(merges)))
        held.append(sums)
        merges.append((a, b, order))
    window: list = [None] * (n + len(merges))
    if window:
        window[-1] = np.arange(k)
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        left, right = np.empty(k, np.int64), np.empty(k, np.int64)
        left[order] = right[k - 1 - order] = window[n + at]
        window[a], window[b], window[n + at] = left, right, None
    out: list[list[int]] = [[] for _ in range(k)]
    for item in range(n):
        out[window[item][-1]].append(item)
    return out


def pack(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows of at most ``capacity``, as lists of items: differencing with a rising number of windows.

    No item is larger than the capacity, so as many windows as items are always enough.
    """
    k = -(-sum(sizes) // capacity)
    while sizes:
        windows = [sorted(w) for w in difference(sizes, k) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1
    return []


def pieces_of(batches: Iterable[pa.RecordBatch], path: str, end_id: int, window: int) -> Iterator[tuple[int, int, int, memoryview]]:
    """(doc_id, start, doc tokens, ids as bytes) of each piece, whole windows first."""
    encode, end = _tokens.vocabulary(path).encode, np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), texts_of(batch.column(1)), strict=True):
            data = memoryview(encode(text.decode("utf-8", "replace")).tobytes() + end)
            n, doc_id = len(data) // 4, doc_id.as_py()
            for start in range(0, n, window):
                yield doc_id, start, n, data[4 * start : 4 * (start + window)]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, piece: int = PIECE, group: int = GROUP, spare: int = SPARE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: where it is in its document, its crc32, and its place in a sequence."""
    path = vocabulary or _tokens.default_path()
    piece, mark = min(piece, window), group * max(1, window - spare)

    def run(batches):
        context = TaskContext.get()
        sequence, rows, waiting, held = (context.partitionId() if context else 0) << 33, [], [], 0

        def place(part, offset):
            doc_id, start, n, data = part
            rows.append((doc_id, start, len(data) // 4, zlib.crc32(data), n, sequence, offset))

        def settle():
            nonlocal sequence, waiting, held
            for members in pack([len(p[3]) // 4 for p in waiting], window):
                offset = 0
                for i in members:
                    place(waiting[i], offset)
                    offset += len(waiting[i][3]) // 4
                sequence += 1
            waiting, held = [], 0

        def out():
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in _SCHEMA.split(", ")])

        for doc_id, start, n, data in pieces_of(batches, path, end_id, window):
            size = len(data) // 4
            if size == window:
                place((doc_id, start, n, data), 0)
                sequence += 1
            else:
                at = 0
                while at < size:
                    taken = min(piece, size - at, mark - held)
                    waiting.append((doc_id, start + at, n, data[4 * at : 4 * (at + taken)]))
                    at, held = at + taken, held + taken
                    if held == mark:
                        settle()
            if len(rows) >= 20_000:
                yield out()
                rows = []
        settle()
        yield out()

    return narrow(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
