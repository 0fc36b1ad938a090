"""Media columns as MPEG transport streams.

Muxing: a payload is cut into access units of UNIT bytes. Each unit is one packetised elementary packet with a
presentation time stamp, TICKS apart, in 188-byte transport packets on one elementary PID. Every GROUP-th unit is a
random-access point: it is preceded by the program tables, and its first packet carries the random-access flag and
the clock reference. Demuxing gathers the program association and map tables' sections, over as many packets as they
take, checks their CRCs and follows the latest version that applies; follows the continuity counter of every PID,
reassembles the elementary packets, and lists time stamps and random-access points.

Null and empty texts have a payload of 64 zero bytes. Equal texts give equal bytes. A damaged stream isn't an error
of the query: its counters say what is missing (`errors`), and the payload is what could be reassembled. Null and
repeated ids and repeated rows are a stream each. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W

PACKET = 188
UNIT = 16_384
TICKS = 3_600
GROUP = 4
PAD = 64
PMT_PID, STREAM_PID, PROGRAM, PRIVATE_DATA, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
SLICE = 4 << 20


@cache
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(value)
    return out


def section_crc(data: bytes) -> int:
    value, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ table[value >> 24 ^ byte]
    return value


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@cache
def _table_packets() -> tuple[bytes, bytes]:
    """The program association and map tables' packets, counters at 0."""
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    return tuple(b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + s + b"\xff" * (PACKET - 5 - len(s)) for pid, s in ((0, pat), (PMT_PID, pmt)))


def _stamp(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def _elementary(unit: bytes, pts: int) -> bytes:
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit


def _fill(packet: np.ndarray, part: np.ndarray, head: bytes) -> None:
    """part at the end of a packet; before it the adaptation field: its length byte, head or its flags, and stuffing."""
    free = 184 - len(part)
    if free:
        packet[3] |= 0x20
        packet[4] = free - 1
    if free > 1:
        packet[5] = 0
        packet[5 : 5 + len(head)] = np.frombuffer(head, dtype=np.uint8)
    packet[PACKET - len(part) :] = part


def _packets(elementary: bytes, counter: int, clock: int | None) -> np.ndarray:
    """Transport packets of one elementary packet; clock: the reference of a random-access point."""
    first_field = b""
    if clock is not None:
        base = clock & (1 << 33) - 1
        first_field = b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")
    first = min(len(elementary), 184 - (len(first_field) + 1 if first_field else 0))
    rest = len(elementary) - first
    n = 1 + -(-rest // 184)
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    data = np.frombuffer(elementary, dtype=np.uint8)
    whole = rest // 184
    out[1 : 1 + whole, 4:] = data[first : first + whole * 184].reshape(whole, 184)
    _fill(out[0], data[:first], first_field)
    if 1 + whole < n:
        _fill(out[n - 1], data[first + whole * 184 :], b"")
    return out


def mux(payload: bytes) -> bytes:
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        entry = k % GROUP == 0
        if entry:
            for packet in _table_packets():
                out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
        made = _packets(_elementary(payload[at : at + UNIT], k * TICKS), counter, k * TICKS if entry else None)
        counter += len(made)
        out.append(made.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    units: int = 0
    stream_type: int = -1
    errors: int = 0
    stamps: list[int] = field(default_factory=list)
    #: of each random-access point: the time stamp and the number of its transport packet
    entries: list[tuple[int, int]] = field(default_factory=list)


def sections(packets: list[tuple[bool, bytes]]) -> tuple[list[bytes], int]:
    """The whole sections with a right CRC that one PID's packets (unit start, payload) carry, and how many were lost.
    A section may span packets; where one starts, a pointer tells how far the one before goes on."""
    found, lost, held = [], 0, b""

    def cut(data: bytes) -> bytes:
        nonlocal lost
        while len(data) >= 3 and data[0] != 0xFF:  # 0xFF: stuffing up to the packet's end
            size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if len(data) < size:
                return data
            if size >= 12 and section_crc(data[:size]) == 0:
                found.append(data[:size])
            else:
                lost += 1
            data = data[size:]
        return data if 0 < len(data) < 3 and data[0] != 0xFF else b""

    for starts, payload in packets:
        if starts and payload:
            before, after = payload[1 : 1 + payload[0]], payload[1 + payload[0] :]
            lost += bool(cut(held + before) if held else b"")
            held = cut(after)
        elif held:
            held = cut(held + payload)
    return found, lost + bool(held)


def current(found: list[bytes], table: int, number: int | None = None) -> list[bytes]:
    """The bodies of the latest version that applies, by section number; number: of the program."""
    apply = [s for s in found if s[0] == table and s[5] & 1 and number in (None, int.from_bytes(s[3:5], "big"))]
    latest = {s[6]: s[8:-4] for s in apply if s[5] >> 1 & 31 == apply[-1][5] >> 1 & 31}
    return [latest[k] for k in sorted(latest)]


def demux(media: bytes) -> Stream:
    out = Stream(packets=len(media) // PACKET)
    rows = np.frombuffer(media, dtype=np.uint8)[: out.packets * PACKET].reshape(-1, PACKET)
    out.errors += int(len(media) % PACKET > 0) + int((rows[:, 0] != 0x47).sum())
    number = np.flatnonzero(rows[:, 0] == 0x47)
    rows = rows[number]
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    begins, control, counter = (rows[:, 1] & 0x40) > 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    start = np.where(control & 2, 5 + rows[:, 4].astype(np.int64), 4)
    flags = np.where(((control & 2) > 0) & (rows[:, 4] > 0), rows[:, 5], 0)
    has = (control & 1) > 0
    for one in np.unique(pid):
        own = counter[(pid == one) & has].astype(np.int64)
        out.errors += int((np.diff(own) % 16 != 1).sum())
    def carried(one: int) -> list[bytes]:
        own = np.flatnonzero((pid == one) & has)
        whole, lost = sections([(bool(begins[i]), rows[i, start[i] :].tobytes()) for i in own])
        out.errors += lost
        return whole

    stream = None
    for body in current(carried(0), 0):
        for k in range(0, len(body) - 3, 4):
            if stream is not None or body[k : k + 2] == b"\0\0":
                continue
            for program in current(carried(int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF), 2, int.from_bytes(body[k : k + 2], "big")):
                at = 4 + (int.from_bytes(program[2:4], "big") & 0xFFF)
                if len(program) >= at + 5:
                    out.stream_type, stream = program[at], int.from_bytes(program[at + 1 : at + 3], "big") & 0x1FFF
    mine = np.flatnonzero((pid == stream) & has) if stream is not None else np.empty(0, np.int64)
    if not len(mine):
        out.errors += 1
        return out
    whole = rows[mine][np.arange(PACKET) >= start[mine][:, None]].tobytes()
    ahead = np.concatenate(([0], np.cumsum(PACKET - np.minimum(start[mine], PACKET))))
    heads = np.flatnonzero(begins[mine])
    parts = []
    for i, end in zip(heads.tolist(), [*heads[1:].tolist(), len(mine)], strict=True):
        unit = whole[ahead[i] : ahead[end]]
        if unit[:3] != b"\0\0\1" or len(unit) < 14 or int.from_bytes(unit[4:6], "big") != len(unit) - 6:
            out.errors += 1
            continue
        t = unit[9:14]
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        out.stamps.append(pts)
        if flags[mine[i]] & 0x40:
            out.entries.append((pts, int(number[mine[i]])))
        parts.append(unit[9 + unit[8] :])
    out.units, out.payload = len(parts), b"".join(parts)
    return out


def text_payload(text: bytes) -> bytes:
    """Padded with zero bytes to a positive multiple of PAD."""
    return text.ljust(max(PAD, -(-len(text) // PAD) * PAD), b"\0")


def muxed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media: each whole text as a transport stream."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column(1), SLICE):
                text = data.tobytes()
                media = [mux(text_payload(text[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def demuxed(media: DataFrame, id_col: str = "doc_id", with_payload: bool = False) -> DataFrame:
    """What the stored bytes say: digests of payload and media, counts, time stamps, random-access points and a summary."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "errors", "stamps", "entries", "payload"][: 11 + with_payload]
    entry = pa.struct([("pts", pa.int64()), ("packet", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(entry), pa.binary()]
        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 256):
                some, rows = batch.slice(lo, 256), []
                for name, n_bytes, stored in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    found = demux(stored or b"")
                    feature = f"packets={found.packets};units={found.units};type={found.stream_type};errors={found.errors};last_pts={found.stamps[-1] if found.stamps else -1};entries={len(found.entries)};last_entry={'%d@%d' % found.entries[-1] if found.entries else -1}"
                    rows.append(
                        (name, n_bytes, len(found.payload), hashlib.sha256(found.payload).hexdigest(), zlib.crc32(found.payload[-PAD:]), len(stored or b""), hashlib.sha256(stored or b"").hexdigest(), feature)
                        + (found.errors, found.stamps, [{"pts": a, "packet": b} for a, b in found.entries], found.payload)[: 3 + with_payload]
                    )
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    fields = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, errors long, stamps array<long>, entries array<struct<pts: long, packet: long>>"
    narrow = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return narrow.mapInArrow(run, fields + ", payload binary" * with_payload).withColumnRenamed("id", id_col)
