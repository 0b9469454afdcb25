"""Media columns (operator 4): MPEG transport streams.

A payload is stored as private data in access units of a programme: a programme association table and a
programme map table, then one packetised elementary stream whose packets carry presentation
timestamps, with a random-access indicator and a clock reference on the first packet of each unit.
Reading parses the tables, checks every continuity counter, reassembles the elementary packets and
returns the payload with what it found.

Defined cases: null is stored like empty; an empty payload is a stream with one empty unit; damaged
streams are read as far as they go, `lost` counts the gaps in continuity counters and `bad` the packets
or sections that fail their checks; documents that repeat have equal results, a row each; empty tables give
empty results; other columns are ignored, whatever their names; of a very long text all is stored.  Memory grows with one text at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the transport stream format and of this programme.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PROGRAM = 188, 0x47, 0x0000, 0x1000, 0x0100, 1
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
UNIT_BYTES, TICKS = 48_000, 3003


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000))
)


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29 & 0x0E), (pts >> 14 & 0xFFFE) | 1, (pts << 1 & 0xFFFE) | 1)


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _unit(payload: bytes, pts: int, counter: int) -> np.ndarray:
    """The transport packets of one access unit."""
    pes = struct.pack(">IHBBB", 0x00000100 | PRIVATE_STREAM, len(payload) + 8, 0x84, 0x80, 5) + _stamp(pts) + payload
    clock = struct.pack(">IH", pts >> 1 & 0xFFFFFFFF, (pts & 1) << 15 | 0x7E00)
    first = min(len(pes), PACKET - 12)
    rest = len(pes) - first
    n = 1 + -(-rest // 184)
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
    raw = np.frombuffer(pes, dtype=np.uint8)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = PACKET - 5 - first, 0x50
    out[0, 6:12] = np.frombuffer(clock, dtype=np.uint8)
    out[0, PACKET - first :] = raw[:first]
    full = rest // 184
    out[1 : 1 + full, 4:] = raw[first : first + full * 184].reshape(full, 184)
    if tail := rest - full * 184:
        out[-1, 3] |= 0x20
        out[-1, 4] = 183 - tail
        if tail < 183:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = raw[-tail:]
    return out


def write_stream(payload: bytes) -> bytes:
    """A payload as a transport stream; the same payload always gives the same bytes."""
    parts, counter = [TABLES], 0
    for i, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        unit = _unit(payload[at : at + UNIT_BYTES], i * TICKS, counter)
        counter += len(unit)
        parts.append(unit.tobytes())
    return b"".join(parts)


class Stream(NamedTuple):
    payload: bytes
    programs: dict
    stamps: list
    entry_points: list
    packets: int
    lost: int
    bad: int


def _read_section(packet: bytes) -> bytes | None:
    at = 5 + packet[4] if not packet[3] & 0x20 else 6 + packet[4] + packet[5 + packet[4]]
    length = 3 + (int.from_bytes(packet[at + 1 : at + 3], "big") & 0xFFF)
    section = packet[at : at + length]
    return section if len(section) == length and crc_mpeg(section) == 0 else None


def read_stream(media: bytes) -> Stream:
    """Parse a transport stream: tables, continuity, elementary packets, timestamps, random-access points."""
    whole = len(media) // PACKET
    grid = np.frombuffer(media, dtype=np.uint8, count=whole * PACKET).reshape(whole, PACKET)
    bad = int((grid[:, 0] != SYNC).sum()) + (len(media) != whole * PACKET)
    grid = grid[grid[:, 0] == SYNC]
    pid = (grid[:, 1].astype(np.int64) & 0x1F) << 8 | grid[:, 2]
    programs: dict[int, dict] = {}
    kinds: dict[int, int] = {}
    for row in grid[(pid == PAT_PID) & (grid[:, 1] & 0x40 > 0)]:
        if (s := _read_section(row.tobytes())) is None:
            bad += 1
            continue
        for at in range(8, len(s) - 4, 4):
            number, target = struct.unpack(">HH", s[at : at + 4])
            programs[number] = {"pmt": target & 0x1FFF, "streams": {}}
    for number, program in programs.items():
        for row in grid[(pid == program["pmt"]) & (grid[:, 1] & 0x40 > 0)]:
            if (s := _read_section(row.tobytes())) is None:
                bad += 1
                continue
            at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while at + 5 <= len(s) - 4:
                es = int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF
                program["streams"][es] = kinds[es] = s[at]
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    out, stamps, entries, lost = [], [], [], 0
    for es in kinds:
        rows = grid[pid == es]
        field = rows[:, 3] & 0x20 > 0
        skip = np.where(field, 5 + rows[:, 4].astype(np.int64), 4)
        bad += int((skip > PACKET).sum())
        counters = rows[:, 3].astype(np.int64) & 15
        lost += int(((counters[1:] - counters[:-1]) % 16 != 1).sum())
        begins = np.flatnonzero(rows[:, 1] & 0x40)
        inside = np.arange(PACKET)[None, :] >= skip[:, None]
        flat = rows[inside].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.maximum(PACKET - skip, 0))])
        for i, b in enumerate(begins):
            e = begins[i + 1] if i + 1 < len(begins) else len(rows)
            pes = flat[ends[b] : ends[e]]
            if pes[:3] != b"\0\0\1" or len(pes) < 9 or len(pes) < 6 + int.from_bytes(pes[4:6], "big"):
                bad += 1
                continue
            if pes[7] & 0x80:
                stamps.append(_unstamp(pes[9:14]))
            if field[b] and rows[b, 4] and rows[b, 5] & 0x40:
                entries.append(stamps[-1] if stamps else 0)
            out.append(pes[9 + pes[8] : 6 + int.from_bytes(pes[4:6], "big")])
    return Stream(b"".join(out), programs, stamps, entries, whole, lost, bad)


def padded(text: str | bytes | None, multiple: int = 64) -> tuple[bytes, int]:
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    return raw + bytes(-len(raw) % multiple if raw else multiple), len(raw)


def feature(s: Stream) -> str:
    return f"programs={len(s.programs)};packets={s.packets};units={len(s.stamps)};random_access={len(s.entry_points)};pts={min(s.stamps, default=0)}-{max(s.stamps, default=0)};lost={s.lost};bad={s.bad}"


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) to (id, media binary): each text as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                media = write_stream(padded(batch.column(1)[i].as_py())[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([media], pa.binary())], [id_col, "media"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, media binary")


def decode(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, media) to (id, payload binary, feature string, first_pts long, lost int, bad int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = read_stream(batch.column(1)[i].as_py() or b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([s.payload], pa.binary()), pa.array([feature(s)], pa.string()), pa.array([min(s.stamps, default=None)], pa.int64()), pa.array([s.lost], pa.int32()), pa.array([s.bad], pa.int32())],
                    [id_col, "payload", "feature", "first_pts", "lost", "bad"],
                )

    return df.select(id_col, "media").mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, payload binary, feature string, first_pts long, lost int, bad int")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Store every text of (doc_id, text), read the stored bytes back, and describe both.

    Storing and reading run in one pass, one text at a time, so the streams never cross a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                payload, n = padded(batch.column(1)[i].as_py())
                media = write_stream(payload)
                s = read_stream(media)
                rows.append((n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)))
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types)]], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)
