"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised and gathered into groups of GROUP tokens within a partition. A document's full windows are
cut off first. What is left of each document is one piece, and multiway differencing deals the pieces to windows: each
piece starts as a partial partition (its length, 0, ..., 0); the two partial partitions of the largest spread are
merged, the fullest bins of one on the emptiest of the other, until one remains. The window count starts at the least
possible and rises whenever the fullest window exceeds the capacity. Only where it would rise by more than a share of
ROOM are pieces halved, down to a 64th of the capacity, and dealt again; so most documents below the capacity stay
whole.

A small group (the last of a partition) can't spread the rest over many windows. Where rounding up would pad more than
ROOM, its rest is cut off into sequences at powers of two, which need no padding: one each for the bits set in the
rest's length, rounded up to a multiple of STEP.

Nothing is shuffled: a group is a run of one partition's rows, of bounded size whatever the data, and sequence ids
are the partition's number and a running number in it. Null and empty texts are documents of the end id alone.
Repeated rows and ids, and rows of a null id, are packed each on its own. An empty table gives no rows. Further columns
are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.tokens import encoder

GROUP = 1 << 20
STEP = 64
#: The share of windows that may be added before pieces are cut, and of tokens that a group's rest may be padded by.
ROOM = 0.01


def differencing(sizes: list[int], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's bin and each bin's load. Ties go by order of the items."""
    if not sizes or bins < 2:
        return np.zeros(len(sizes), dtype=np.int64), np.array([sum(sizes)] * bins, dtype=np.int64)
    heap, loads, merges = [], {}, []
    for i, size in enumerate(sizes):
        loads[i] = np.zeros(bins, dtype=np.int64)
        loads[i][0] = size
        heap.append((-size, i))
    heapq.heapify(heap)
    least = {i: 0 for i in loads}
    fresh = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        summed = loads.pop(a) + loads.pop(b)[::-1]
        order = np.argsort(-summed, kind="stable")
        summed = summed[order]
        floor = int(summed[-1])
        least[fresh] = least[a] + least[b] + floor
        loads[fresh] = summed - floor
        merges.append((fresh, a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(loads[fresh][0]), fresh))
        fresh += 1
    last = heap[0][1]
    seats = {last: np.arange(bins)}
    for made, a, b, order in reversed(merges):
        mine = seats.pop(made)
        for child, places in ((a, order), (b, bins - 1 - order)):
            if child < len(sizes):
                seats[child] = mine[int(np.flatnonzero(places == 0)[0])]
            else:
                seats[child] = own = np.empty(bins, dtype=np.int64)
                own[places] = mine
    final = np.array([seats[i] for i in range(len(sizes))])
    return final, np.bincount(final, weights=sizes, minlength=bins).astype(np.int64)


def pack(lengths: list[int], capacity: int = 4096) -> list[tuple[int, int, int, int]]:
    """(document, start, length, window) of every piece; windows are numbered from 0."""
    out, window, left = [], 0, []
    for doc, length in enumerate(lengths):
        for start in range(0, length - capacity + 1, capacity):
            out.append((doc, start, capacity, window))
            window += 1
        if length % capacity:
            left.append((doc, length - length % capacity, length % capacity))
    total = sum(size for _, _, size in left)
    bins, rest = divmod(total, capacity)
    apart, limit = 0, capacity
    if rest and capacity - rest > ROOM * total:
        apart, limit = min(total, -(-(rest + bins * STEP // 4) // STEP) * STEP), max(1, capacity // 16)
    left.sort(key=lambda piece: -piece[2])
    left, powers = _cut(left, apart, capacity)
    for number, (doc, start, size) in powers:
        out.append((doc, start, size, window + number))
    window += 1 + max((number for number, _ in powers), default=-1)
    if left:
        pieces, seats = dealt(left, capacity, limit, int(ROOM * sum(lengths) / capacity))
        out += [(*piece, window + int(seat)) for piece, seat in zip(pieces, seats, strict=True)]
    return out


def dealt(left: list[tuple[int, int, int]], capacity: int, limit: int, rise: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """The pieces (document, start, length) of at most `limit` tokens, and the window of each. rise: by how much the
    window count may rise before the pieces are halved."""
    least = -(-sum(size for _, _, size in left) // capacity)
    while True:
        pieces = [(doc, start + k * size // n, (k + 1) * size // n - k * size // n) for doc, start, size in left for n in [-(-size // limit)] for k in range(n)]
        bins, last = least, limit <= max(1, capacity // 64)
        while last or bins <= least + rise:
            seats, loads = differencing([size for _, _, size in pieces], bins)
            if loads.max() <= capacity:
                return pieces, seats
            bins += 1
        limit = max(1, limit // 2)


def _cut(left: list[tuple[int, int, int]], apart: int, capacity: int) -> tuple[list, list]:
    """left without `apart` tokens of its smallest pieces; those, dealt to full windows and sequences at powers of two."""
    rest, powers = list(left), []
    sizes = [capacity] * (apart // capacity) + [1 << bit for bit in reversed(range(capacity.bit_length())) if apart % capacity >> bit & 1]
    for number, need in enumerate(sizes):
        while need:
            doc, start, size = rest.pop()
            took = min(size, need)
            powers.append((number, (doc, start, took)))
            need -= took
            if took < size:
                rest.append((doc, start + took, size - took))
    return rest, powers


_FIELDS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (binary)."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = _FIELDS[: 7 + with_ids]

    def emit(held: list, first: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
        pieces = pack([len(ids) for _, ids in held], capacity)
        pieces.sort(key=lambda p: (p[3], p[0], p[1]))
        rows, last, offset = [], -1, 0
        for doc, start, length, window in pieces:
            offset = offset if window == last else 0
            name, ids = held[doc]
            own = ids[start : start + length].tobytes()
            rows.append((name, start, length, zlib.crc32(own), len(ids), first + window, offset, own)[: len(fields)])
            last, offset = window, offset + length
        kinds = [held_type[0], *[pa.int64()] * 6, pa.binary()]
        yield first + last + 1, [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=fields)]

    held_type: list[pa.DataType] = [pa.null()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        held, tokens, first = [], 0, TaskContext.get().partitionId() << 36
        for batch in W.runs(batches):
            held_type[0] = batch.schema.field(0).type
            for name, ids in zip(batch.column(0).to_pylist(), encode.rows(batch.column(1), end_id), strict=True):
                held.append((name, ids))
                tokens += len(ids)
                if tokens >= 2 * GROUP:  # half stays, so that the last group isn't small
                    part, gone = 0, 0
                    while gone < GROUP and part < len(held):
                        gone += len(held[part][1])
                        part += 1
                    for first, made in emit(held[:part], first):
                        yield from made
                    held, tokens = held[part:], tokens - gone
        if held:
            for _, made in emit(held, first):
                yield from made

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {kind}, " + ", ".join(f"{c} long" for c in _FIELDS[1:7]) + ", ids binary" * with_ids
    return narrow.mapInArrow(W.tidy(run), kinds).withColumnRenamed("id", id_col)
