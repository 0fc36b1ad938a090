import hashlib
import io
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, token_files, tokens
from tessera.llm import transport_stream as ts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.sampled_from([1, 7, 300, 60_000, 2**32]))
def test_blocks_come_back(ids, most):
    ids = np.array(ids, dtype=np.uint64) % most
    ids[::97] = 2**32 - 1  # outliers
    data, lengths = token_files.encode_blocks(ids.astype(np.uint32))
    assert len(data) == lengths.sum()
    if len(ids):
        assert (token_files.decode_blocks(data, np.cumsum(lengths) - lengths) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(256, dtype=np.uint32) % 16
    ids[::40] = 50_000
    data, _ = token_files.encode_blocks(ids)
    assert len(data) < 256 * 4 // 8 + 16 + 6 * 7


def test_a_reader_fetches_any_stretch():
    buffer = io.BytesIO()
    writer = token_files.ShardWriter(buffer)
    rows = [np.random.default_rng(i).integers(0, 50_000, n, dtype=np.uint32) for i, n in enumerate((1, 0, 300, 70_000, 5))]
    for i, ids in enumerate(rows):
        writer.add(i, ids)
    writer.close()
    reader = token_files.ShardReader(pa.BufferReader(buffer.getvalue()))
    flat = np.concatenate(rows)
    assert [(d, s, ids.tolist()) for d, s, ids in reader.rows()] == [(i, sum(map(len, rows[:i])), r.tolist()) for i, r in enumerate(rows)]
    for a, b in ((0, 1), (255, 257), (299, 70_000), (5, 5)):
        assert (reader.ids(a, b) == flat[a:b]).all()
    with pytest.raises(ValueError):
        token_files.ShardReader(pa.BufferReader(buffer.getvalue()[:-1]))


def brute_ids(name, text, end):
    return np.array([*tokens.encoder(tokens.vocabulary(name)).tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def plain_token_files(rows, name, end):
    """doc_id: (n_tokens, crc) of each of its rows, sorted; and every id's first start."""
    found, starts, at = defaultdict(list), {}, 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = brute_ids(name, text, end)
        found[doc].append((len(ids), zlib.crc32(ids.tobytes())))
        starts.setdefault(doc, at)
        at += len(ids)
    return {d: sorted(v) for d, v in found.items()}, starts


def same_files(got, rows, name, end):
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    want, starts = plain_token_files(rows, name, end)
    assert {d: sorted(x[1:] for x in v) for d, v in found.items()} == want
    for doc, pieces in found.items():
        at = starts[doc]
        for start, n, _ in sorted(pieces):
            assert start == at
            at += n


@pytest.mark.parametrize("shard_bytes", [token_files.SHARD_BYTES, 40])
def test_token_files_of_odd_documents(odd_docs, shard_bytes):
    name = "byte_bpe_50k.json"
    manifest = token_files.write_shards(odd_docs, tokens.vocabulary(name), shard_bytes=shard_bytes)
    got = token_files.read_shards(manifest, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    same_files(got, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], name, 0)
    assert manifest.count() > 3 if shard_bytes == 40 else manifest.count() == 1


def test_a_common_id_is_dealt_to_many_tasks_and_shards(table, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_TASKS", 3)
    rows = [(None, f"text number {i % 40}") for i in range(300)] + [(5, "the same text")] * 200 + [(i, "w " * i) for i in range(6, 60)]
    manifest = token_files.write_shards(table(rows, "doc_id long, text string").repartition(4), tokens.vocabulary("byte_bpe_50k.json"), shard_bytes=600)
    listed = manifest.collect()
    assert {r.task for r in listed} == {0, 1, 2} and max(r.shard for r in listed) > 3 and max(r.documents for r in listed) < 120
    same_files(token_files.read_shards(manifest).collect(), rows, "byte_bpe_50k.json", 0)


def test_registered_token_query_against_brute_force(spark):
    from tessera.llm import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same_files(queries.op1_token_files(spark, "/root/testdata/sf0.001").collect(), rows, "byte_bpe_50k.json", 0)


def test_registered_packing_query_against_brute_force(spark):
    from tessera.llm import queries

    got, windows, pieces = queries.op3_packing(spark, "/root/testdata/sf0.001").collect(), defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    padding = 0
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert set(pieces) == set(rows) and padding <= 0.03 * sum(r.length for r in got)
    for doc, text in rows.items():
        ids, at = brute_ids("word_bpe_49k.json", text, 2), 0
        for start, length, crc, n in sorted(pieces[doc]):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_token_files_of_an_empty_table(odd_docs):
    assert token_files.read_shards(token_files.write_shards(odd_docs.limit(0), tokens.vocabulary("byte_bpe_50k.json"))).collect() == []


def loads(lengths, out, capacity):
    load, per = defaultdict(int), defaultdict(list)
    for doc, start, length, window in out:
        assert length > 0
        load[window] += length
        per[doc].append((start, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(per[doc]):
            assert start == at
            at += n
        assert at == length
    assert max(load.values(), default=0) <= capacity and set(load) == set(range(len(load)))
    return load


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60), st.sampled_from([16, 64, 100, 4096]))
def test_packing_is_a_partition_within_capacity(lengths, capacity):
    loads(lengths, packing.pack(lengths, capacity), capacity)


def test_packing_leaves_little_padding():
    draw = np.random.default_rng(4)
    for lengths in ([3000] * 150, [4097] * 200, draw.integers(1, 9000, 400).tolist(), (draw.pareto(1, 500) * 300 + 1).astype(int).tolist()):
        load = loads(lengths, packing.pack(lengths), 4096)
        assert sum(4096 - v for v in load.values() if v & (v - 1)) <= 0.03 * sum(lengths)


def test_the_window_count_rises_when_a_window_exceeds_the_capacity(monkeypatch):
    tried = []

    def watched(sizes, bins, real=packing.differencing):
        tried.append((bins, int(real(sizes, bins)[1].max())))
        return real(sizes, bins)

    monkeypatch.setattr(packing, "differencing", watched)
    lengths = [97, 97, 97, 97, 2, 2, 2, 2, 2] * 40
    pieces, seats = packing.dealt([(i, 0, n) for i, n in enumerate(lengths)], 100, 100, 500)
    assert len(tried) > 1 and all(load > 100 for _, load in tried[:-1]) and tried[-1][1] <= 100
    assert [b for b, _ in tried] == list(range(tried[0][0], tried[-1][0] + 1)) and seats.max() < tried[-1][0] and len(pieces) == len(lengths)


def test_documents_below_the_capacity_stay_whole():
    draw = np.random.default_rng(7)
    lengths = np.minimum(draw.lognormal(5.5, 1.0, 2000), 4000).astype(int).tolist()
    out = packing.pack(lengths)
    load = loads(lengths, out, 4096)
    assert len(out) <= len(lengths) * 1.01
    assert sum(4096 - v for v in load.values() if v & (v - 1)) <= 0.02 * sum(lengths)
    assert sum(v < 4096 and not v & (v - 1) for v in load.values()) <= 7


def test_differencing_gives_near_equal_bins():
    sizes = [8, 7, 6, 5, 4]
    seats, load = packing.differencing(sizes, 2)
    assert sorted(load.tolist()) == [14, 16] and len(seats) == 5
    draw = np.random.default_rng(1).integers(1, 1000, 400).tolist()
    load = packing.differencing(draw, 20)[1]
    assert load.max() - load.min() < 40 and load.sum() == sum(draw)


def test_packing_of_odd_documents(odd_docs):
    name = "word_bpe_49k.json"
    got = packing.packed(odd_docs, tokens.vocabulary(name), capacity=256, with_ids=True).collect()
    want = sorted((str(r.doc_id), brute_ids(name, r.text, 2).tobytes()) for r in odd_docs.select("doc_id", "text").collect())
    windows, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        windows[r.sequence_id].append((r.offset, r.length))
        docs[(str(r.doc_id), r.doc_tokens)].append((r.start, bytes(r.ids)))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in got) == sum(len(ids) // 4 for _, ids in want)
    single = [(d, b) for d, b in want if sum(x == d for x, _ in want) == 1]
    assert sorted((d, b"".join(x for _, x in sorted(docs[(d, len(b) // 4)]))) for d, b in single) == single
    assert packing.packed(odd_docs.limit(0), tokens.vocabulary(name)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 700), st.integers(0, 255))
def test_a_stream_comes_back(n, byte):
    payload = ts.text_payload(bytes([byte]) * n)
    found = ts.demux(ts.mux(payload))
    assert found.payload == payload and found.errors == 0


def test_long_payloads_stamps_and_entries():
    for n in (ts.UNIT - 1, ts.UNIT, ts.UNIT + 1, 9 * ts.UNIT + 5):
        payload = ts.text_payload(os.urandom(n))
        found = ts.demux(ts.mux(payload))
        assert found.payload == payload and found.stamps == [k * ts.TICKS for k in range(found.units)]
        assert [p for p, _ in found.entries] == found.stamps[:: ts.GROUP]


def test_damage_is_counted():
    media = bytearray(ts.mux(ts.text_payload(os.urandom(50_000))))
    lost = bytes(media[: 188 * 20] + media[188 * 21 :])
    assert ts.demux(lost).errors > 0
    media[188 * 3] = 0
    assert ts.demux(bytes(media)).errors > 0
    assert ts.demux(b"").errors > 0 and ts.demux(b"junk").payload == b""
    assert ts.section_crc(b"123456789") == 0x0376E6E7  # the published check value


def test_streams_of_odd_documents(odd_docs):
    got = ts.demuxed(ts.muxed(odd_docs), with_payload=True).collect()
    want = sorted((r.text or "").encode() for r in odd_docs.select("text").collect())
    assert sorted(bytes(r.payload[: r.n_bytes]) for r in got) == want
    for r in got:
        assert r.payload_bytes == len(r.payload) >= 64 and r.payload_bytes % 64 == 0 and r.errors == 0
        assert r.payload_sha256 == hashlib.sha256(r.payload).hexdigest() and r.tail_crc32 == zlib.crc32(r.payload[-64:])
        assert r.media_bytes % 188 == 0 and set(r.payload[r.n_bytes :]) <= {0}
    assert ts.demuxed(ts.muxed(odd_docs.limit(0))).collect() == []


def spread_table(pid, section):
    """A section over as many packets as it takes, the first with a pointer."""
    data, out, counter = b"\0" + section, [], 0
    while data:
        out.append(b"\x47" + ((0x4000 if not out else 0) | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15]) + data[:184].ljust(184, b"\xff"))
        data, counter = data[184:], counter + 1
    return b"".join(out)


def map_section(version, pid, descriptors, applies=1):
    body = (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(descriptors)).to_bytes(2, "big") + descriptors + bytes([6]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00"
    head = b"\x02" + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1" + bytes([0xC0 | version << 1 | applies]) + b"\0\0"
    return head + body + ts.section_crc(head + body).to_bytes(4, "big")


def test_tables_over_several_packets_and_their_latest_version():
    payload = ts.text_payload(os.urandom(3000))
    media = ts.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    stream = b"".join(packets[2:])
    descriptors = b"".join(bytes([5, 200]) + bytes(200) for _ in range(4))
    long = packets[0] + spread_table(ts.PMT_PID, map_section(0, ts.STREAM_PID, descriptors)) + stream
    found = ts.demux(long)
    assert found.payload == payload and found.errors == 0 and len(long) > len(media) + 3 * 188
    wrong = ts.demux(packets[0] + spread_table(ts.PMT_PID, map_section(1, 0x0222, b"")) + stream)
    assert wrong.payload == b"" and wrong.errors > 0
    whole = spread_table(ts.PMT_PID, map_section(1, 0x0222, b"")), spread_table(ts.PMT_PID, map_section(2, ts.STREAM_PID, descriptors))
    later = packets[0] + whole[0] + b"".join(whole[1][i : i + 3] + bytes([whole[1][i + 3] + 1 & 15 | 0x10]) + whole[1][i + 4 : i + 188] for i in range(0, len(whole[1]), 188)) + stream
    assert ts.demux(later).payload == payload and ts.demux(later).errors == 0
    ahead = packets[0] + packets[1] + spread_table(ts.PMT_PID, map_section(3, 0x0222, b"", applies=0)).replace(b"\x10", b"\x11", 1) + stream
    assert ts.demux(ahead).payload == payload
    cut = packets[0] + spread_table(ts.PMT_PID, map_section(0, ts.STREAM_PID, descriptors))[: 3 * 188] + stream
    assert ts.demux(cut).errors > 0


def test_registered_stream_query_against_brute_force(spark):
    from tessera.llm import queries

    rows = sorted((r.doc_id, ts.text_payload((r.text or "").encode()), len((r.text or "").encode())) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = sorted(queries.op5_transport_stream(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d for d, *_ in rows]
    for r, (_, payload, n) in zip(got, rows, strict=True):
        media = ts.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.errors) == (len(media), hashlib.sha256(media).hexdigest(), 0)
        assert r.stamps == [k * ts.TICKS for k in range(-(-len(payload) // ts.UNIT))] and [e.pts for e in r.entries] == r.stamps[:: ts.GROUP]
        for e in r.entries:  # the packet that an entry names carries the random-access flag
            packet = media[188 * e.packet : 188 * e.packet + 188]
            assert packet[3] & 0x20 and packet[5] & 0x40
