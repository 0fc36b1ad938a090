"""Token-id shards in patched frame-of-reference blocks.

A shard is one file:

    magic "PFR1"
    blocks, one after another
    block index: the byte place of each block, u64 each
    documents: id i64, first token in the shard u64 each
    footer: blocks u64, documents u64, tokens u64, magic "PFR1"

A block holds up to BLOCK ids: count u16, width u8, exceptions u16, minimum u32, then every id less the minimum,
its low `width` bits packed, then the exceptions: place u16 each, high bits u32 each. The width is that of the
PERCENTILE-th percentile of the block's differences; what is wider is an exception. All integers are little-endian.

Writing: documents are range-partitioned by id, so that file order is id order; each task sorts its rows, encodes
them and writes one shard after another, a new one after SHARD_BYTES of text. A shard's name is its attempt's own, and
only the manifest, a table in the shared folder with a row per shard, says which count; so a lost or repeated task
leaves no torn file. A corpus beyond MOST_TASKS shards gives each task more shards, not larger ones. A shard's first
token in the corpus is that of its task, from one total a task, and what the task wrote before. Reading: shards are
read in parallel, a run of blocks at a time.

Null texts are empty documents of the end id alone. Repeated ids are stored each, in order of a hash of their texts; a
null id comes first and is stored as the least 64-bit integer, which is read back as null. Rows of one id are dealt by
that hash, and equal rows by their place in the input, so no id is too common for a task. An empty table gives no shard
and no row. Further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.store import fresh_path, stored
from tessera.llm.tokens import encoder

MAGIC = b"PFR1"
BLOCK = 256
PERCENTILE = 95
#: Bytes of text that a shard is meant to hold (a longer document alone), and the most tasks that write or read.
SHARD_BYTES = 24 << 20
MOST_TASKS = 20_000
#: Blocks that are packed or read at once.
RUN = 4096
NO_ID = -(1 << 63)
_HEAD = np.dtype([("count", "<u2"), ("width", "u1"), ("exceptions", "<u2"), ("minimum", "<u4")])
_MANIFEST = "task int, shard int, path string, documents long, tokens long, ahead long"


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the runs of these lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes, each block's length). Every block but the last holds BLOCK ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    padded = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    padded[: len(ids)] = ids
    padded = padded.reshape(n, BLOCK)
    head = np.zeros(n, dtype=_HEAD)
    head["count"] = BLOCK
    head["count"][-1] = len(ids) - (n - 1) * BLOCK
    head["minimum"] = padded.min(axis=1)
    rest = padded - head["minimum"][:, None]
    usual = np.partition(rest, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    head["width"] = np.frexp(usual.astype(np.float64))[1]
    over = rest >> head["width"][:, None].astype(np.uint64)  # 64 bits: a width of 32 shifts everything out
    head["exceptions"] = (over > 0).sum(axis=1)
    bodies: list[bytes] = [b""] * n
    for width in np.unique(head["width"]):
        rows = np.flatnonzero(head["width"] == width)
        if width:
            bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, count=int(width), bitorder="little")
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            for row, body in zip(rows.tolist(), packed, strict=True):
                bodies[row] = body.tobytes()
    row, place = np.nonzero(over)
    place, high = place.astype("<u2"), over[row, place].astype("<u4")
    edges = np.searchsorted(row, np.arange(n + 1))
    out = []
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        out.append(b"".join([head[i].tobytes(), bodies[i], place[a:b].tobytes(), high[a:b].tobytes()]))
    return b"".join(out), np.array([len(x) for x in out], dtype=np.int64)


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these bytes of data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(starts)
    head = raw[starts[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD)[:, 0]
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    body = starts + _HEAD.itemsize
    width = head["width"].astype(np.int64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = raw[body[rows][:, None] + np.arange(BLOCK * w // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        out[rows] = np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, 32 - w))), axis=2, bitorder="little").view("<u4")[:, :, 0]
    count = head["exceptions"].astype(np.int64)
    if count.any():
        block = np.repeat(np.arange(n), count)
        tail = np.repeat(body + BLOCK // 8 * width, count)
        nth = _places(count)
        place = raw[(tail + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        high = raw[(tail + 2 * np.repeat(count, count) + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[block, place] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    out += head["minimum"][:, None]
    return out[np.arange(BLOCK) < head["count"][:, None]]


class ShardWriter:
    """One shard; bounded memory, but for 16 bytes a document and 8 a block."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = 0
        self.blocks: list[np.ndarray] = []
        self.documents: list[tuple[int, int]] = []
        stream.write(MAGIC)

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.documents.append((doc, self.tokens))
        self.held.append(ids)
        self.tokens += len(ids)
        self.waiting += len(ids)
        if self.waiting >= RUN * BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate([*self.held, np.empty(0, np.uint32)])
        data, lengths = encode_blocks(ids[:n])
        self.stream.write(data)
        self.blocks.append(self.at + np.cumsum(lengths) - lengths)
        self.at += len(data)
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.waiting)
        blocks = np.concatenate(self.blocks)
        self.stream.write(blocks.astype("<u8").tobytes())
        self.stream.write(np.array(self.documents, dtype="<i8").reshape(-1, 2).tobytes())
        self.stream.write(struct.pack("<3Q", len(blocks), len(self.documents), self.tokens) + MAGIC)


class ShardReader:
    """A shard in a seekable stream."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        tail = 24 + len(MAGIC)
        stream.seek(size - tail)
        *counts, magic = struct.unpack("<3Q4s", stream.read(tail))
        if magic != MAGIC:
            raise ValueError("not a whole shard")
        n, docs, self.tokens = counts
        self.end = size - tail - 16 * docs - 8 * n
        stream.seek(self.end)
        self.blocks = np.frombuffer(stream.read(8 * n), "<u8").astype(np.int64)
        self.documents = np.frombuffer(stream.read(16 * docs), "<i8").reshape(-1, 2)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end, from their blocks alone."""
        if end <= start:
            return np.empty(0, np.uint32)
        lo, hi = start // BLOCK, -(-end // BLOCK)
        edge = self.blocks[hi] if hi < len(self.blocks) else self.end
        self.stream.seek(int(self.blocks[lo]))
        data = self.stream.read(int(edge - self.blocks[lo]))
        return decode_blocks(data, self.blocks[lo:hi] - self.blocks[lo])[start - lo * BLOCK : end - lo * BLOCK]

    def rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, first token, ids) in order, a bounded run of blocks at a time."""
        starts = np.append(self.documents[:, 1], self.tokens)
        lo = 0
        while lo < len(self.documents):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + RUN * BLOCK, side="right")) - 1)
            ids = self.ids(int(starts[lo]), int(starts[hi]))
            for i in range(lo, hi):
                yield int(self.documents[i, 0]), int(starts[i]), ids[starts[i] - starts[lo] : starts[i + 1] - starts[lo]]
            lo = hi


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes docs in ascending id order and returns the manifest (task, shard, path, documents, tokens, start)."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.monotonically_increasing_id().alias("place")]
    narrow = docs.select(*keys, F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, -(-size // shard_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        attempt, shard, ahead, filled, writer = uuid.uuid4().hex, 0, 0, 0, None

        def closed() -> pa.RecordBatch:
            nonlocal shard, ahead, filled, writer
            writer.close()
            stream.close()
            row = (task, shard, f"{folder}/{name}", len(writer.documents), writer.tokens, ahead)
            shard, ahead, filled, writer = shard + 1, ahead + writer.tokens, 0, None
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)], names=["task", "shard", "path", "documents", "tokens", "ahead"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for doc, length, ids in zip(batch.column("id").to_pylist(), lengths, encode.rows(batch.column("text"), end_id), strict=True):
                if writer and filled + length > shard_bytes:
                    yield closed()
                if writer is None:
                    name = f"{task:06d}-{shard:06d}-{attempt}.pfr"
                    stream = files.open_output_stream(f"{base}/{name}")
                    writer = ShardWriter(stream)
                writer.add(doc, ids)
                filled += length
        if writer:
            yield closed()

    order = ["id", "hash", "place"]
    written = stored(narrow.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(W.tidy(run), _MANIFEST), "token-manifest")
    totals = written.groupBy("task").agg(F.sum("tokens").alias("n")).orderBy("task").collect()  # MOST_TASKS at most
    starts = np.cumsum([0, *(r.n for r in totals)]).tolist()
    begun = spark.createDataFrame([(r.task, s) for r, s in zip(totals, starts, strict=False)], "task int, begin long")
    return written.join(F.broadcast(begun), "task").select("task", "shard", "path", "documents", "tokens", (F.col("begin") + F.col("ahead")).alias("start"))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary)."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    kinds = [*[pa.int64()] * 4, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                files, path = pafs.FileSystem.from_uri(shard["path"])
                with files.open_input_file(path) as stream:
                    rows = []
                    for doc, first, ids in ShardReader(stream).rows():
                        data = ids.astype("<u4").tobytes()
                        rows.append((None if doc == NO_ID else doc, shard["start"] + first, len(ids), zlib.crc32(data), data)[: len(names)])
                        if len(rows) == 4096:
                            yield _batch(rows, names, kinds)
                            rows = []
                    if rows:
                        yield _batch(rows, names, kinds)

    tasks = min(MOST_TASKS, max(1, manifest.count()))
    return manifest.repartitionByRange(tasks, "task", "shard").mapInArrow(W.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
