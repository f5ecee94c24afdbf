"""Transport streams: exact round trips, tables, counters, timestamps."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import transport_stream as ts


@pytest.mark.parametrize("n", [1, 64, 161, 162, 163, 176, 184, 185, 346, 347, 348, 32767, 32768, 32769, 32930, 40000, 700_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = ts.mux(data)
    found = ts.demux(media)
    assert len(media) % 188 == 0 and found.samples == data and not found.continuity_errors
    assert found.units == len(found.points) == -(-n // ts.PES_SAMPLES)
    assert [t for t, _, _ in found.points] == [k * ts.PES_SAMPLES * 90000 // 8000 % (1 << 33) for k in range(found.units)]
    assert [s for _, _, s in found.points] == [k * ts.PES_SAMPLES for k in range(found.units)]


def by_hand(media):
    """A plain reader of its own: byte by byte, as the standard has it."""

    def crc(data):
        c = 0xFFFFFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (c >> 31 ^ byte >> bit) & 1 else 0)
        return c

    counters, tables, data, points = {}, {}, [], []
    for number in range(len(media) // 188):
        p = media[188 * number : 188 * (number + 1)]
        assert p[0] == 0x47 and not p[1] & 0x80
        pid, start, has_field, has_body = (p[1] & 31) << 8 | p[2], p[1] & 0x40, p[3] & 0x20, p[3] & 0x10
        assert has_body and counters.get(pid, p[3] - 1 & 15) == p[3] - 1 & 15
        counters[pid] = p[3] & 15
        body, access = p[4:], False
        if has_field:
            field, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            access = bool(field) and bool(field[0] & 0x40)
            if field and field[0] & 0x10:
                clock = int.from_bytes(field[1:6], "big") >> 7
        if pid in (0, 0x1000):
            section = body[1 + body[0] :]
            section = section[: 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)]
            assert crc(section) == 0
            tables[pid] = section
            continue
        assert pid == int.from_bytes(tables[0x1000][13:15], "big") & 0x1FFF and int.from_bytes(tables[0][10:12], "big") & 0x1FFF == 0x1000
        if start:
            assert body[:3] == b"\0\0\1" and access
            b = body[9:14]
            ticks = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
            assert ticks == clock
            points.append((ticks, number, sum(map(len, data))))
            left = int.from_bytes(body[4:6], "big") - 3 - body[8]
            body = body[9 + body[8] :]
        data.append(body[:left])
        left -= len(data[-1])
    return b"".join(data), points


@pytest.mark.parametrize("n", [64, 161, 192, 32768, 100_032, 600_000])
def test_streams_are_read_alike_by_hand(n):
    data = random.Random(n).randbytes(n)
    media, points = ts.mux_with_points(data)
    assert by_hand(media) == (data, points) and ts.demux(media).points == points and hashlib.sha256(media).hexdigest() == hashlib.sha256(ts.mux(data)).hexdigest()


def test_seeking_reads_the_packets_it_needs(monkeypatch):
    data = random.Random(7).randbytes(300_000)
    media, points = ts.mux_with_points(data)
    read = []
    monkeypatch.setattr(ts, "_packets", lambda m, was=ts._packets: read.append(len(m)) or was(m))
    for first, count in [(0, 10), (32767, 2), (32768, 1), (100_000, 70_000), (299_999, 5), (5, 0), (400_000, 3), (0, 300_000)]:
        assert ts.samples_from(media, points, first, count) == data[first : first + count]
    read.clear()
    ts.samples_from(media, points, 200_000, 100)
    assert sum(read) < len(media) / 5
    assert ts.samples_from(b"", [], 0, 5) == b""


def test_points_stored_with_the_media_are_checked(spark, docs):
    media = ts.store(docs([(1, "x" * 100_000), (2, None), (None, "z")]))
    assert {r.doc_id: r.samples for r in ts.read_samples(media, 99_990, 20).collect()} == {1: bytearray(b"x" * 10 + b"\0" * 10), 2: bytearray(), None: bytearray()}
    other = media.selectExpr("doc_id", "n_bytes", "media", "transform(points, p -> named_struct('ticks', p.ticks + 1, 'packet', p.packet, 'sample', p.sample)) AS points")
    with pytest.raises(Exception, match="access points"):
        ts.digest(other).collect()


def test_empty_stream():
    assert ts.demux(ts.mux(b"")).samples == b"" and ts.pad(b"") == bytes(64)


def test_lost_packet_is_counted_and_damage_raises():
    media = ts.mux(bytes(20_000))
    assert ts.demux(media[: 188 * 10] + media[188 * 11 :]).continuity_errors == 1
    with pytest.raises(ValueError, match="sync"):
        ts.demux(media[:188] + b"\0" + media[189:])
    with pytest.raises(ValueError, match="table"):
        ts.demux(media[:20] + b"\xee" + media[21:])
    with pytest.raises(ValueError, match="whole"):
        ts.demux(media[:-1])


def test_repeated_packet_is_read_once():
    media = ts.mux(random.Random(1).randbytes(5000))
    assert ts.demux(media[: 188 * 6] + media[188 * 5 : 188 * 6] + media[188 * 6 :]).samples == ts.demux(media).samples


def test_documents(spark, docs):
    rows = [(1, "aé"), (2, None), (3, ""), (4, "x" * 64), (5, "y" * 300_000), (1, "aé")]
    out = ts.round_trip(docs(rows)).collect()
    assert len(out) == 6
    for r in out:
        raw = (dict(rows)[r.doc_id] or "").encode()
        padded = ts.pad(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(ts.mux(padded)).hexdigest() and r.media_bytes == len(ts.mux(padded))
    assert len({r[1:] for r in out if r.doc_id == 1}) == len({r[1:] for r in out if r.doc_id in (2, 3)}) == 1
    assert ts.round_trip(docs([])).count() == 0
