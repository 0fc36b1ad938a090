"""Chat formatting after cumulative-snapshot collapse.

A log that stores a conversation anew after every turn holds prefixes of it. The state of a conversation after its
k-th turn is a rolling hash over roles and texts; a conversation goes if its whole state is the state of a longer one
after as many turns, or if an equal one has a lesser id. What remains is rendered.

The rolling hash is a sum: turn k adds digest(role, text) * BASE^k modulo 2^64, in two lanes, so it can be formed in
parts. Rows are range-partitioned by (conversation, turn, role); each partition numbers and adds up its own rows, and
where a conversation began in an earlier partition, that one's total is carried on: one row per partition, on the
driver. So no conversation is ever collected, however long. The anti-join is an equi-join on turns and state.

Turn order is turn (null first), then role, then text; equal rows are a turn each. Null roles and texts count as
empty. Rows without a conversation id are ignored. A rendered conversation has one row per `segment_turns` turns
(SEGMENT unless given), so no row grows with a conversation; 0 gives one row a conversation, for those that fit in
memory. Rows are dealt by the first PREFIX characters of their texts too, so turns without a number don't all meet in
one task. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import stored

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1
SEGMENT = 256
PREFIX = 64
START, STOP = "<|im_start|>", "<|im_end|>"
_FIELDS = [("conv", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_()), ("part", pa.int64()), ("opening", pa.int64())]
_SQL = "conv long, role string, text string, k long, a long, b long, more boolean, part long, opening long"


def _signed(value: int) -> int:
    value &= MASK
    return value - (1 << 64) if value >> 63 else value


def turn_digest(role: str, text: str) -> tuple[int, int]:
    """The role's length goes first, so that role and text can't run into each other."""
    raw = role.encode()
    data = hashlib.blake2b(len(raw).to_bytes(8, "little") + raw + text.encode(), digest_size=16).digest()
    return int.from_bytes(data[:8], "little"), int.from_bytes(data[8:], "little")


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and state within the partition. more: the next row goes on; null at the partition's last row."""
    part, opening, last = TaskContext.get().partitionId(), None, None
    k, sums, powers = 0, [0, 0], [1, 1]
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            opening = conv if opening is None else opening
            if last is not None:
                rows.append((*last, conv == last[0], part, None))
            if last is None or conv != last[0]:
                k, sums, powers = 0, [0, 0], [1, 1]
            k += 1
            for lane, digest in enumerate(turn_digest(role, text)):
                powers[lane] = powers[lane] * BASES[lane] & MASK
                sums[lane] = sums[lane] + digest * powers[lane] & MASK
            last = (conv, role, text, k, _signed(sums[0]), _signed(sums[1]))
        if rows:
            yield _table(rows)
    if last is not None:
        yield _table([(*last, None, part, opening)])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def carries(edges: list[tuple[int, int, int, int, int, int]]) -> dict[int, tuple[int, int, int, int, bool]]:
    """edges: (part, first conversation, last one, its turns, a, b there), in order of part. Returns for each part
    the (conversation, turns, a, b) that its first conversation brings along, and whether its last row's goes on."""
    out, held = {}, (None, 0, 0, 0)
    for i, (part, first, last, k, a, b) in enumerate(edges):
        goes_on = i + 1 < len(edges) and edges[i + 1][1] == last
        brought = held if held[0] == first else (first, 0, 0, 0)
        out[part] = (*brought, goes_on)
        if first == last:
            n = brought[1]
            held = (last, n + k, brought[2] + a * pow(BASES[0], n, 1 << 64) & MASK, brought[3] + b * pow(BASES[1], n, 1 << 64) & MASK)
        else:
            held = (last, k, a & MASK, b & MASK)
    return out


def states(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, role, text, k, a, b, more): each turn's number and the state after it; more: another turn follows."""
    spark = turns.sparkSession
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).where("conv is not null")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = stored(rows.repartitionByRange(parts, *order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text").mapInArrow(_local, _SQL), "turns")
    edges = local.where("opening is not null").orderBy("part").select("part", "opening", "conv", "k", "a", "b").collect()  # one a partition
    brought = carries([tuple(e) for e in edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for conv, role, text, k, a, b, more, part, opening in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start, n, x, y, goes_on = brought[part]
                if conv == start and n:
                    k, a, b = k + n, x + a * pow(BASES[0], n, 1 << 64), y + b * pow(BASES[1], n, 1 << 64)
                found.append((conv, role, text, k, _signed(a), _signed(b), goes_on if opening is not None else more))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), _FIELDS, strict=False)], names=[n for n, _ in _FIELDS[:7]])

    return local.mapInArrow(run, "conv long, role string, text string, k long, a long, b long, more boolean")


def maximal(found: DataFrame) -> DataFrame:
    """(conv, turns): of the conversations in states, those that neither a longer one nor an equal one of lesser id covers."""
    whole = found.where("not more").groupBy("k", "a", "b").agg(F.min("conv").alias("conv"))
    inner = found.where("more").select("k", "a", "b").distinct()
    return whole.join(inner, ["k", "a", "b"], "left_anti").select("conv", F.col("k").alias("turns"))


def rendered(turns: DataFrame, conv_col: str = "conv_id", segment_turns: int = SEGMENT, **columns) -> DataFrame:
    """conv_col, segment, n_turns, chat: the maximal conversations in chat markup, segment_turns turns a row."""
    segment = F.floor((F.col("k") - 1) / segment_turns) if segment_turns else F.lit(0).cast("long")
    found = stored(states(turns, conv_col, **columns).withColumn("segment", segment), "states")
    kept = found.join(maximal(found).select("conv"), "conv", "left_semi")
    turn = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(STOP + "\n"))
    ordered = F.array_sort(F.collect_list(F.struct("k", turn.alias("turn"))))
    return kept.groupBy(F.col("conv").alias(conv_col), "segment").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(ordered, lambda t: t["turn"]), "").alias("chat"))
