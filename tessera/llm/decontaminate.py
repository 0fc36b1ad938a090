"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are sets of word shingles of `width` words; an item of fewer words is one shingle of all its words, and
documents are shingled at that width too, so short items are found inside long documents. Items are partitioned by the
size of their sets, in powers of two, and every partition has an index of its own:

* its sketch size, min(SKETCH, its least possible size): each of its items is represented by so many of its least
  shingle hashes (bottom-k MinHash, a random subset of the set);
* its threshold, the number of sketch values that a document must hold. By the hypergeometric law an item of any size
  in the partition whose containment reaches `percent` shows fewer with probability below MISS;
* its least document: one with too few shingles to hold `percent` of the partition's smallest item doesn't look.

Unlike a fixed-size signature of the document, this doesn't lose short items in long documents. Every candidate is then
verified by exact containment on the full shingle sets.

The document side is one pass without a shuffle: rows meet the indexes by a bitmap and a sorted search. Distinct item
texts go out in blocks of at most BLOCK_BYTES (a longer text alone), each block one pass over the documents, so a large
benchmark takes more passes, not more memory.

Null, empty and wordless texts hold nothing and are held by nothing. Repeated rows give repeated pairs; equal items are
each reported. A null document id or item id is kept as null. Without documents or items there are no pairs. Further
columns are ignored, or passed on by `decontaminated`, which decides on every row by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.store import stored

MISS = 1e-9
SKETCH = 32
BLOCK_BYTES = 16 << 20
_BITS = 20


def needed_hits(size: int, sketch: int, percent: int) -> int:
    """The fewest sketch values that an item of `size` shingles shows, but for MISS, where percent of them are held."""
    held = ceil(size * percent / 100)
    below = 0.0
    for hits in range(sketch + 1):
        below += comb(held, hits) * comb(size - held, sketch - hits) / comb(size, sketch)
        if below >= MISS:
            return max(1, hits)
    return sketch


class Partition:
    """The index of the items (numbers into sets) whose sets have 2^k to 2^(k+1) - 1 shingles."""

    def __init__(self, k: int, items: np.ndarray, sets: list[np.ndarray], percent: int):
        self.sketch = min(SKETCH, 1 << k)
        sizes = {len(sets[i]) for i in items}
        self.needed = min(needed_hits(n, self.sketch, percent) for n in sizes)
        self.least = ceil(min(sizes) * percent / 100)
        values = np.concatenate([sets[i][: self.sketch] for i in items])  # sets are sorted by hash
        owners = np.repeat(items, self.sketch)
        order = np.argsort(values, kind="stable")
        self.values, first = np.unique(values[order], return_index=True)
        self.owners, self.starts = owners[order], np.append(first, len(values))

    def candidates(self, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs with enough sketch values, from the shingles' rows and values."""
        seat = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        real = self.values[seat] == values
        if not real.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([rows[real], seat[real]]), axis=1)
        fan = self.starts[pairs[1] + 1] - self.starts[pairs[1]]
        ahead = np.concatenate(([0], np.cumsum(fan)))
        owner = self.owners[np.arange(ahead[-1]) - np.repeat(ahead[:-1] - self.starts[pairs[1]], fan)]
        (row, item), hits = np.unique(np.stack([np.repeat(pairs[0], fan), owner]), axis=1, return_counts=True)
        return row[hits >= self.needed], item[hits >= self.needed]


class Index:
    """The partitions of one block of items, by the width of their shingles."""

    def __init__(self, texts: list[str | None], percent: int, width: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []
        widths = []
        for _, _, hashed, bounds in W.words(pa.array(texts, pa.string())):
            counts = np.diff(bounds)
            for i, n in enumerate(counts.tolist()):
                widths.append(min(n, width))
                own = bounds[i : i + 2] - bounds[i]
                self.sets.append(np.unique(W.shingle(hashed[bounds[i] : bounds[i + 1]], own, widths[-1])[0]) if n else np.empty(0, W.U))
        sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        level = np.frexp(np.maximum(sizes, 1))[1] - 1
        self.partitions: dict[int, list[Partition]] = {}
        self.bitmaps: dict[int, np.ndarray] = {}
        for w in sorted(set(widths) - {0}):
            own = np.array(widths) == w
            self.partitions[w] = [Partition(int(k), np.flatnonzero(own & (level == k)), self.sets, percent) for k in np.unique(level[own])]
            self.bitmaps[w] = np.zeros(1 << _BITS, dtype=bool)
            for part in self.partitions[w]:
                self.bitmaps[w][part.values >> np.uint64(64 - _BITS)] = True

    def search(self, hashed: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of each verified pair, from the rows' word hashes."""
        for width, partitions in self.partitions.items():
            found, edges = W.shingle(hashed, bounds, width)
            at = np.flatnonzero(self.bitmaps[width][found >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            rows, lengths = np.searchsorted(edges, at, side="right") - 1, np.diff(edges)
            lengths[np.diff(bounds) < width] = 0  # a text of fewer words has no shingle of this width
            for part in partitions:
                look = lengths[rows] >= part.least
                last, own = -1, found[:0]
                for r, i in zip(*(x.tolist() for x in part.candidates(rows[look], found[at[look]])), strict=True):
                    if r != last:
                        last, own = r, np.unique(found[edges[r] : edges[r + 1]])
                    shared = len(np.intersect1d(self.sets[i], own, assume_unique=True))
                    if 100 * shared >= self.percent * len(self.sets[i]):
                        yield r, i, shared


def _blocks(items: DataFrame, text_col: str) -> Iterator[list]:
    """The distinct texts as (key, text), in blocks of bounded bytes, and last the table (key, text)."""
    texts = stored(items.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct().withColumn("key", F.monotonically_increasing_id()), "items")
    blocks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    block_of = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for block in range(blocks):
        yield [(r.key, r.text) for r in texts.where(block_of == block).collect()]
    yield texts


def _pairs(docs: DataFrame, items: list, percent: int, width: int, kind: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([text for _, text in sent.value], percent, width)
        for batch in batches:
            rows, which, shared = [], [], []
            for lo, _, hashed, bounds in W.words(batch.column(1)):
                for r, i, n in index.search(hashed, bounds):
                    rows.append(lo + r), which.append(i), shared.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([sent.value[i][0] for i in which], pa.int64()),
                    pa.array([len(index.sets[i]) for i in which], pa.int64()),
                    pa.array(shared, pa.int64()),
                ],
                names=["id", "key", "n_item", "n_shared"],
            )

    return docs.mapInArrow(W.tidy(run), f"id {kind}, key long, n_item long, n_shared long")


def contained_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80, width: int = 5
) -> DataFrame:
    """(id_col, item_col, n_item, n_shared) of each document and item with 100 * n_shared >= percent * n_item shingles."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    *blocks, texts = _blocks(benchmark, item_text_col)
    found = reduce(DataFrame.unionByName, [_pairs(narrow, block, percent, width, kind) for block in blocks])
    named = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).join(texts, "text").select("key", "item")
    return found.join(named, "key").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared")


def _without(docs: DataFrame, items: list, text_col: str, percent: int, width: int) -> DataFrame:
    sent, place = docs.sparkSession.sparkContext.broadcast(items), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([text for _, text in sent.value], percent, width)
        for batch in W.runs(batches):
            clean = np.ones(batch.num_rows, dtype=bool)
            for lo, _, hashed, bounds in W.words(batch.column(place)):
                for r, _, _ in index.search(hashed, bounds):
                    clean[lo + r] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(W.tidy(run), docs.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """docs without the rows whose text holds an item: decided where the row is read, with nothing shuffled."""
    *blocks, _ = _blocks(benchmark, item_text_col)
    return reduce(lambda kept, block: _without(kept, block, text_col, percent, width) if block else kept, blocks, docs)
