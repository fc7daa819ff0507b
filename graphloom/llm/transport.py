"""Media columns as MPEG transport streams.

A payload becomes a single-program stream: program association and map tables,
then one elementary stream of private data in packets (PES) of up to UNIT
bytes.  Each of those starts in a transport packet that carries a clock
reference, a timestamp and the random-access flag.  Reading parses the tables,
checks the continuity counters, drops repeated packets, reassembles the
elementary packets and lists timestamps with their random-access points.

All work on packets is on whole numpy arrays of 188-byte rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0, 0x1FFF
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CRC_POLYNOMIAL, CLOCK = 0x04C11DB7, 90_000

PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Bytes of payload in one elementary packet, and timestamp ticks between two.
UNIT, TICKS = 32_768, 3600


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return (s := head + body) + crc32_mpeg(s).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack(
    [
        _table_packet(PAT_PID, _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))),
        _table_packet(PMT_PID, _section(2, PROGRAM, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0, PRIVATE_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0]))),
    ]
)


def _timestamp(pts: int, marker: int = 2) -> bytes:
    return bytes([marker << 4 | (pts >> 29 & 0xE) | 1, pts >> 22 & 0xFF, (pts >> 14 & 0xFE) | 1, pts >> 7 & 0xFF, (pts << 1 & 0xFE) | 1])


def _clock(base: int) -> bytes:
    return bytes([base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0])


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream that holds payload; an empty payload is one empty elementary packet."""
    parts, counter = [_TABLES], 0
    for number, at in enumerate(range(0, max(1, len(payload)), unit)):
        pts = number * TICKS % (1 << 33)
        body = payload[at : at + unit]
        data = np.frombuffer(bytes([0, 0, 1, PRIVATE_STREAM]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts) + body, np.uint8)
        first = min(176, len(data))
        rest = len(data) - first
        packets = np.empty((1 + -(-rest // 184), PACKET), np.uint8)
        n = len(packets)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter = (counter + n) % 16
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4], packets[0, 5] = 183 - first, 0x50  # random access, clock reference
        packets[0, 6:12] = np.frombuffer(_clock(pts), np.uint8)
        packets[0, 12 : PACKET - first] = 0xFF
        packets[0, PACKET - first :] = data[:first]
        whole, tail = divmod(rest, 184)
        packets[1 : 1 + whole, 4:] = data[first : first + whole * 184].reshape(whole, 184)
        if tail:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - tail
            packets[-1, 5 : PACKET - tail] = 0xFF
            if tail < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - tail :] = data[len(data) - tail :]
        parts.append(packets)
    return np.concatenate(parts).tobytes()


@dataclass
class Stream:
    """What a transport stream holds: program rows, elementary packets and faults."""

    programs: list[dict] = field(default_factory=list)
    units: list[dict] = field(default_factory=list)
    payload: bytes = b""
    packets: int = 0
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("sync", "continuity", "repeated", "table", "unit"), 0))


def _sections(payloads: list[bytes], starts: list[bool], faults: dict) -> list[bytes]:
    """Sections with a right checksum.

    Each packet with a unit start says where its first new section begins: what
    is before that ends the section under way, and reading goes on there, so a
    broken section costs itself only.
    """
    out, runs, data = [], [], None
    for payload, start in zip(payloads, starts, strict=True):
        if start and payload:
            at = 1 + payload[0]
            if data is not None:
                runs.append(data + payload[1:at])
            data = payload[at:]
        elif data is not None:
            data += payload
    for run in [*runs, *([data] if data is not None else [])]:
        while run and run[0] != 0xFF:
            size = 3 + ((run[1] & 0x0F) << 8 | run[2]) if len(run) >= 3 else len(run) + 1
            section, run = run[:size], run[size:]
            if len(section) < size or crc32_mpeg(section):
                faults["table"] += 1
            elif section not in out:  # tables are sent again and again
                out.append(section)
    return out


def demux(stream: bytes | None) -> Stream:
    """Parse a stream; faults are counted, not raised.  Null or empty: nothing found."""
    out = Stream()
    stream = stream or b""
    rows = np.frombuffer(stream, np.uint8)[: len(stream) // PACKET * PACKET].reshape(-1, PACKET)
    good = rows[:, 0] == SYNC
    out.faults["sync"] = int((~good).sum()) + bool(len(stream) % PACKET)
    rows = rows[good]
    out.packets = len(rows)
    if not len(rows):
        return out
    pid = (rows[:, 1] & 0x1F).astype(np.int64) << 8 | rows[:, 2]
    start, control, counter = rows[:, 1] & 0x40 > 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    begin = np.where(control & 2 > 0, 5 + rows[:, 4].astype(np.int64), 4)
    begin = np.where(control & 1 > 0, np.minimum(begin, PACKET), PACKET)
    access = (control & 2 > 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0)

    def sections(of: int) -> list[bytes]:
        at = np.flatnonzero(pid == of)
        return _sections([rows[i, begin[i] :].tobytes() for i in at], list(start[at]), out.faults)

    for pat in sections(PAT_PID):
        for i in range(8, len(pat) - 4, 4):
            program, pmt_pid = pat[i] << 8 | pat[i + 1], (pat[i + 2] & 0x1F) << 8 | pat[i + 3]
            for pmt in sections(pmt_pid) if program else []:
                at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
                while at < len(pmt) - 4:
                    out.programs.append({"program": program, "pmt_pid": pmt_pid, "pid": (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2], "stream_type": pmt[at]})
                    at += 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])
    payload, offset = [], 0
    for media in dict.fromkeys(p["pid"] for p in out.programs):
        at = np.flatnonzero((pid == media) & (control & 1 > 0))
        if len(at) > 1:
            same = np.append(False, counter[at[1:]] == counter[at[:-1]])
            same[1:] &= (rows[at[1:]] == rows[at[:-1]]).all(1)
            out.faults["repeated"] += int(same.sum())
            at = at[~same]
            out.faults["continuity"] += int(((counter[at[1:]].astype(int) - counter[at[:-1]] - 1) % 16 != 0).sum())
        cells = rows[at][np.arange(PACKET) >= begin[at][:, None]]
        ends = np.cumsum(PACKET - begin[at])
        starts = np.flatnonzero(start[at])
        edges = [*(int(ends[i] - (PACKET - begin[at[i]])) for i in starts), len(cells)]
        for i, a, b in zip(starts, edges, edges[1:], strict=False):
            unit = cells[a:b].tobytes()
            if len(unit) < 9 or unit[:3] != b"\0\0\1":
                out.faults["unit"] += 1
                continue
            size = unit[4] << 8 | unit[5]
            if size and size + 6 != len(unit):  # a longer unit is cut to its size
                out.faults["unit"] += 1
            pts = None
            if unit[7] & 0x80 and len(unit) >= 14:
                pts = (unit[9] & 0xE) << 29 | unit[10] << 22 | (unit[11] & 0xFE) << 14 | unit[12] << 7 | unit[13] >> 1
            body = unit[9 + unit[8] : size + 6 if size else None]
            out.units.append({"pid": int(media), "pts": pts, "offset": offset, "length": len(body), "random_access": bool(access[at[i]]), "packet": int(at[i])})
            payload.append(body)
            offset += len(body)
    out.payload = b"".join(payload)
    return out


def seek(units: list[dict], pts: int) -> dict | None:
    """The last random-access unit at or before a timestamp."""
    return max((u for u in units if u["random_access"] and u["pts"] is not None and u["pts"] <= pts), key=lambda u: u["pts"], default=None)


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty), filled with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def feature(stream: Stream) -> str:
    """Counts and byte statistics of what was read back, as text."""
    seen = np.bincount(np.frombuffer(stream.payload, np.uint8), minlength=256) if stream.payload else np.zeros(256, int)
    n = int(seen.sum())
    share = seen[seen > 0] / max(1, n)
    points = [u["pts"] for u in stream.units if u["random_access"]]
    faults = sum(stream.faults.values())
    return f"packets={stream.packets};units={len(stream.units)};access={len(points)};last_pts={max((p for p in points if p is not None), default=-1)};faults={faults};mean={float((seen * np.arange(256)).sum() / max(1, n)):.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};distinct={len(share)}"


UNITS = "array<struct<pid:int,pts:long,offset:long,length:int,random_access:boolean,packet:int>>"
PROGRAMS = "array<struct<program:int,pmt_pid:int,pid:int,stream_type:int>>"


def _extended(df: DataFrame, at: str, new: list[tuple[str, str, pa.DataType]], of) -> DataFrame:
    bounded_batches(df.sparkSession)
    names = {n for n, _, _ in new}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    index = df.columns.index(at)

    def run(batches):
        for batch in text_slices(batches, index):
            rows = [of(v) for v in batch.column(index).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _, _ in new)])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, " + ", ".join(f"{n} {t}" for n, t, _ in new))


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_bytes and media: each whole text's payload as a transport stream; null counts as empty."""
    return _extended(docs, text_col, [("n_bytes", "long", pa.int64()), ("media", "binary", pa.binary())], lambda t: (len((t or "").encode("utf-8", "surrogatepass")), mux(payload_of(t))))


def read(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with payload, programs, units, faults and feature, read from the stored bytes; null: an empty payload."""
    integer = pa.int32()
    unit = pa.list_(pa.struct([("pid", integer), ("pts", pa.int64()), ("offset", pa.int64()), ("length", integer), ("random_access", pa.bool_()), ("packet", integer)]))
    program = pa.list_(pa.struct([(n, integer) for n in ("program", "pmt_pid", "pid", "stream_type")]))

    def of(stream):
        s = demux(stream)
        return s.payload, s.programs, s.units, sum(s.faults.values()), feature(s)

    return _extended(media, media_col, [("payload", "binary", pa.binary()), ("programs", PROGRAMS, program), ("units", UNITS, unit), ("faults", "int", integer), ("feature", "string", pa.string())], of)
