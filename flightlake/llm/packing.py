"""Token sequences of bounded length with little padding, by multiway differencing.

A document longer than a window fills whole windows; its rest is cut into pieces.
Pieces of some hundred windows' worth are shared out together: Karmarkar-Karp keeps a
partial partition per piece, merges the two with the largest imbalance so that the
fullest window of one meets the emptiest of the other, and ends with near-equal
windows.  Their number is the least that could hold the pieces and rises by one
whenever a window would exceed its capacity.

Groups are filled in the order of the input partition, so packing needs no shuffle and
no more memory than one group; a long document passes through window by window.

Defined results: null or empty text is its end id alone; a null id is carried along;
repeated rows are packed once each; of equally full windows, and of equally long pieces, the
one that came first is taken first; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm import words
from flightlake.llm.common import ship
from flightlake.llm.tokens import encoder, vocabulary_path

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items of each of ``k`` near-equal windows.

    A merge keeps only which place of either side went where; the windows of the items
    follow from the last merge back to the first.
    """
    n = len(sizes)
    if k == 1 or not n:
        return [list(range(n))] + [[] for _ in range(k - 1)]
    sums = []
    for size in sizes:
        one = np.zeros(k, np.int64)
        one[0] = size
        sums.append(one)
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = (-both).argsort(kind="stable")
        both = both[order]
        both -= both[-1]
        merges.append((a, b, order))
        sums.append(both)
        heapq.heappush(heap, (-int(both[0]), len(sums) - 1))
    window: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    for made in range(len(sums) - 1, n - 1, -1):
        a, b, order = merges[made - n]
        own = window.pop(made)
        window[a], window[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        window[a][order] = own
        window[b][k - 1 - order] = own
    out: list[list[int]] = [[] for _ in range(k)]
    for i in range(n):
        out[int(window[i][0])].append(i)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows that hold all items, none above ``capacity``; no item may exceed it."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        shared = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in shared):
            return [w for w in shared if w]
        k += 1


def _packer(path: str, capacity: int, largest: int, group: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        next_sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def settle() -> None:
            nonlocal next_sequence, waiting, held
            for window in windows([p[2] for p in waiting], capacity):
                offset = 0
                for i in window:
                    doc, start, length, crc, total, ids = waiting[i]
                    rows.append((doc, start, length, crc, total, next_sequence, offset, ids))
                    offset += length
                next_sequence += 1
            waiting, held = [], 0

        def flushed() -> pa.RecordBatch:
            cols = [pa.array([r[j] for r in rows], pa.int64()) for j in range(len(COLUMNS))]
            if with_ids:
                cols.append(pa.array([r[-1] for r in rows], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, [*COLUMNS, "ids"][: len(cols)])

        for batch in batches:
            bounds = words.utf8(batch["text"])[1]
            for a, b in words.portions(bounds):
                part = batch.slice(a, b - a)
                for doc, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    total, at = len(ids), 0
                    while at < total:
                        rest = total - at
                        length = capacity if rest >= capacity else min(rest, largest)
                        cut = ids[at : at + length]
                        piece = (doc, at, length, zlib.crc32(cut), total, cut if with_ids else None)
                        if length == capacity:
                            rows.append((*piece[:5], next_sequence, 0, piece[5]))
                            next_sequence += 1
                        else:
                            waiting.append(piece)
                            held += length
                        at += length
                    if held >= group * capacity:
                        settle()
                    if len(rows) >= 20_000:
                        yield flushed()
        settle()
        yield flushed()

    return run


def packed(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = 1024,
    largest: int = 256,
    group: int = 128,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``largest``: the rest of a document is cut into pieces of at most so many tokens;
    ``group``: windows' worth of pieces shared out together.
    """
    ship(docs.sparkSession)
    run = _packer(path or vocabulary_path(), capacity, largest, group, end_id, with_ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
