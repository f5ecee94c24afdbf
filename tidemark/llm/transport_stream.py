"""Media columns as MPEG transport streams (operator 2).

``mux`` stores 8-bit samples as a program of one private elementary stream:
188-byte packets, program association and program map tables with their CRC,
elementary packets with a presentation time each, and a random-access point with
a clock reference at the start of each. ``demux`` goes the other way: it reads
the program tables, checks sync bytes and continuity counters, reassembles the
elementary packets and lists timestamps with the random-access points.

A media column has the points beside it: (ticks, first packet, first sample) of
each. ``samples_from`` seeks by them and reads only the packets from the point
before the wanted samples to their end; reading a whole stream back checks that
the stored points are those of the stream.

Defined results: a null text is the empty text; an empty text gives one block of
64 zero bytes; texts of any length are stored whole, in elementary packets of
bounded size; a table without rows gives none; a null ``doc_id`` stays null;
repeated rows are stored each for itself; other columns are ignored; a damaged
stream raises ``ValueError`` when a table or packet can't be read, or the points
stored with it aren't its own, and counts lost packets as continuity errors
otherwise.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches, stage, text_of

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0x0000, 0x1000, 0x0101, 0x1FFF
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
CLOCK, SAMPLES_A_SECOND = 90_000, 8_000
PES_SAMPLES = 32_768
#: Program tables are repeated before every so many elementary packets.
TABLES_EVERY = 16
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=64)
def section_crc(data: bytes) -> int:
    """The CRC-32 of program table sections (polynomial 04C11DB7, not reflected)."""
    c = 0xFFFFFFFF
    for byte in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ byte]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_body(section: bytes) -> bytes:
    return (b"\0" + section).ljust(BODY, b"\xff")


_PAT = _table_body(_section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))
_PMT = _table_body(_section(0x02, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])))


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 30 & 7) << 1, ticks >> 22 & 0xFF, 1 | (ticks >> 15 & 0x7F) << 1, ticks >> 7 & 0xFF, 1 | (ticks & 0x7F) << 1])


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def mux(samples: bytes) -> bytes:
    """8-bit samples as a transport stream of one program."""
    return mux_with_points(samples)[0]


def mux_with_points(samples: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The stream and its random-access points: (ticks, first packet, first sample) of each."""
    out: list[np.ndarray] = []
    points: list[tuple[int, int, int]] = []
    written = 0
    counters = {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}

    def tables() -> None:
        for pid, body in ((PAT_PID, _PAT), (PMT_PID, _PMT)):
            head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counters[pid] & 15])
            counters[pid] += 1
            out.append(np.frombuffer(head + body, np.uint8).reshape(1, PACKET))

    for k, at in enumerate(range(0, len(samples), PES_SAMPLES)):
        if k % TABLES_EVERY == 0:
            tables()
            written += 2
        part = samples[at : at + PES_SAMPLES]
        ticks = at * CLOCK // SAMPLES_A_SECOND % (1 << 33)
        header = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks)
        # adaptation field of the first packet: random access and the clock reference
        access = bytes([7, 0x50]) + (ticks << 15 | 0x7E00).to_bytes(6, "big")
        unit = np.frombuffer(header + part, np.uint8)
        room = BODY - len(access)
        rest = max(0, len(unit) - room)
        full, tail = divmod(rest, BODY)
        n = 1 + full + (tail > 0)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counters[DATA_PID] + np.arange(n)) & 15
        counters[DATA_PID] += n
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        first = unit[:room]
        stuffing = room - len(first)
        packets[0, 4 : 4 + len(access)] = np.frombuffer(bytes([7 + stuffing]) + access[1:], np.uint8)
        packets[0, 4 + len(access) : 4 + len(access) + stuffing] = 0xFF
        packets[0, PACKET - len(first) :] = first
        packets[1 : 1 + full, 4:] = unit[room : room + full * BODY].reshape(full, BODY)
        if tail:
            last, field_len = packets[-1], BODY - tail
            last[3] |= 0x20
            last[4] = field_len - 1
            last[5 : 4 + field_len] = 0xFF
            if field_len > 1:
                last[5] = 0
            last[PACKET - tail :] = unit[room + full * BODY :]
        points.append((ticks, written, at))
        written += n
        out.append(packets)
    return np.concatenate(out).tobytes() if out else b"", points


@dataclass
class Stream:
    """What ``demux`` finds: samples, (ticks, first packet, first sample) of each access point, and faults."""

    samples: bytes = b""
    points: list[tuple[int, int, int]] = field(default_factory=list)
    programs: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    units: int = 0
    continuity_errors: int = 0


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]
    length = 3 + (int.from_bytes(raw[at + 1 : at + 3], "big") & 0x0FFF)
    section = raw[at : at + length]
    if len(section) < length or section[0] != table_id or section_crc(section):
        raise ValueError("a program table can't be read")
    return section


def _packets(media: bytes) -> np.ndarray:
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise ValueError("a packet has lost its sync byte")
    return grid


def _pids(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each packet its stream, and whether a unit starts in it."""
    return (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2], grid[:, 1] & 0x40 > 0


def _programs(grid: np.ndarray) -> tuple[dict[int, int], int, int]:
    """Programs with the streams of their maps, the first map's own stream, and the first elementary stream."""
    pid, start = _pids(grid)
    pat = np.flatnonzero((pid == PAT_PID) & start)
    if not len(pat):
        raise ValueError("no program association table")
    body = _read_section(grid[pat[0]], 0x00)[8:-4]
    programs = {int.from_bytes(body[i : i + 2], "big"): int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(body), 4)}
    map_pid = next(iter(programs.values()))
    pmt = np.flatnonzero((pid == map_pid) & start)
    if not len(pmt):
        raise ValueError("no program map table")
    section = _read_section(grid[pmt[0]], 0x02)
    at = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
    return programs, map_pid, int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF


def demux(media: bytes) -> Stream:
    """Read a transport stream back."""
    grid = _packets(media)
    out = Stream(packets=len(grid))
    if not len(grid):
        return out
    out.programs, map_pid, stream = _programs(grid)
    pid, _ = _pids(grid)
    control = grid[:, 3]
    for one in {PAT_PID, map_pid, stream}:
        count = control[(pid == one) & (control & 0x10 > 0)].astype(np.int32) & 15
        step = np.diff(count) & 15
        out.continuity_errors += int(((step != 1) & (step != 0)).sum())

    _read_units(grid, stream, out)
    return out


def _read_units(grid: np.ndarray, stream: int, out: Stream) -> None:
    """Reassemble the elementary packets of a stream: samples, points and number of units."""
    pid, start = _pids(grid)
    control = grid[:, 3]
    own = np.flatnonzero((pid == stream) & (control & 0x10 > 0))
    packets, control = grid[own], control[own]
    repeated = np.concatenate(([False], (np.diff(control.astype(np.int32) & 15) == 0) & (packets[1:] == packets[:-1]).all(1)))
    own, packets, control = own[~repeated], packets[~repeated], control[~repeated]
    offset = np.where(control & 0x20 > 0, 5 + packets[:, 4].astype(np.int32), 4)
    sizes = PACKET - offset
    data = packets[np.arange(PACKET) >= offset[:, None]].tobytes()
    ends = np.cumsum(sizes)
    begins = np.flatnonzero(start[own])
    if not len(begins):
        raise ValueError("no elementary packet starts")
    edges = [*(ends - sizes)[begins].tolist(), len(data)]
    parts, done = [], 0
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if data[a : a + 3] != b"\0\0\1":
            raise ValueError("an elementary packet has no start code")
        length = int.from_bytes(data[a + 4 : a + 6], "big")
        head = 9 + data[a + 8]
        part = data[a + head : min(b, a + 6 + length) if length else b]
        first = packets[begins[k]]
        if first[3] & 0x20 and first[4] and first[5] & 0x40 and data[a + 7] & 0x80:
            out.points.append((_ticks(data[a + 9 : a + 14]), int(own[begins[k]]), done))
        parts.append(part)
        done += len(part)
        out.units += 1
    out.samples = b"".join(parts)


def samples_from(media: bytes, points: list[tuple[int, int, int]], first: int, count: int) -> bytes:
    """``count`` samples from the ``first`` on: read from the random-access point before them, not from the start."""
    begins = [sample for _, _, sample in points]
    k, after = max(0, bisect_right(begins, first) - 1), bisect_left(begins, first + count)
    if not points or count <= 0:
        return b""
    head = _packets(media[: points[0][1] * PACKET])
    end = points[after][1] if after < len(points) else len(media) // PACKET
    some = Stream()
    _read_units(_packets(media[points[k][1] * PACKET : end * PACKET]), _programs(head)[2], some)
    return some.samples[first - begins[k] : first - begins[k] + count]


def feature_of(stream: Stream) -> str:
    """Figures of the samples read back, the same for equal samples."""
    x = np.frombuffer(stream.samples, np.uint8).astype(np.int64)
    total, squares = int(x.sum()), int((x * x).sum())
    crossings = int((np.diff((x >= 128).astype(np.int8)) != 0).sum())
    last = stream.points[-1][0] if stream.points else 0
    return f"packets={stream.packets} units={stream.units} access={len(stream.points)} last_pts={last} lost={stream.continuity_errors} sum={total} squares={squares} crossings={crossings} peak={int(x.max()) if len(x) else 0}"


MEDIA = "doc_id long, n_bytes long, media binary, points array<struct<ticks: long, packet: long, sample: long>>"
_POINTS = pa.list_(pa.struct([("ticks", pa.int64()), ("packet", pa.int64()), ("sample", pa.int64())]))


def _mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # no row of Spark's output batch may wait for the others: a few rows at a time
        raw = [x.encode("utf-8", "surrogatepass") for x in text_of(batch.column(1))]
        for at in range(0, len(raw), 200):
            some = raw[at : at + 200]
            made = [mux_with_points(pad(x)) for x in some]
            points = pa.array([[dict(zip(("ticks", "packet", "sample"), p, strict=True)) for p in points] for _, points in made], _POINTS)
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 200], pa.array([len(x) for x in some], pa.int64()), pa.array([m for m, _ in made], pa.binary()), points], ["doc_id", "n_bytes", "media", "points"])


def store(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media, points): the UTF-8 bytes, padded, as a media column with its random-access points."""
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_mux_batches, MEDIA)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _points_of(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    return [[(p["ticks"], p["packet"], p["sample"]) for p in points] for points in column.to_pylist()]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media, points in zip(batch.column(2), _points_of(batch.column(3)), strict=True):
            media = media.as_buffer()
            found = demux(media)
            if found.points != points:
                raise ValueError("the stored access points aren't those of the stream")
            rows.append((len(found.samples), hashlib.sha256(found.samples).hexdigest(), zlib.crc32(found.samples[-BLOCK:]), media.size, hashlib.sha256(media).hexdigest(), feature_of(found)))
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [x.split()[0] for x in DIGEST.split(", ")])


def digest(media: DataFrame) -> DataFrame:
    """Read every stream of a media column back and describe it."""
    bounded_batches(media.sparkSession, 500)
    return media.select("doc_id", "n_bytes", "media", "points").mapInArrow(_digest_batches, DIGEST)


def read_samples(media: DataFrame, first: int, count: int) -> DataFrame:
    """(doc_id, samples): some samples of every stream, found through its random-access points."""
    bounded_batches(media.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [samples_from(m.as_buffer(), p, first, count) for m, p in zip(batch.column(1), _points_of(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(some, pa.binary())], ["doc_id", "samples"])

    return media.select("doc_id", "media", "points").mapInArrow(run, "doc_id long, samples binary")


def round_trip(documents: DataFrame) -> DataFrame:
    """Store all texts as media in the shared folder, then read the stored bytes back."""
    return digest(stage(store(documents), "media"))
