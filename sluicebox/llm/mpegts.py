"""MPEG transport streams in a binary column: demultiplexing to elementary packets.

Each stream is one value of the column; packets are handled as a NumPy matrix of 188 bytes a row.
Program association and map tables are reassembled from their sections and checked by CRC;
continuity counters are checked per PID; PES packets are put together with their timestamps,
and access points come from the adaptation field's random access indicator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import narrow, text_slices

PACKET = 188
#: PES payload bytes that a result batch holds before it leaves the worker.
FLUSH = 4_000_000

_OUT = pa.schema([("id", pa.int64()), ("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("pes_index", pa.int32()), ("stream_id", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("discontinuity", pa.bool_()), ("complete", pa.bool_()), ("payload", pa.binary())])
DDL = "id bigint, program int, pid int, stream_type int, pes_index int, stream_id int, pts bigint, dts bigint, random_access boolean, discontinuity boolean, complete boolean, payload binary"

_CRC = np.zeros(256, dtype=np.uint32)
for _i in range(256):
    _r = _i << 24
    for _ in range(8):
        _r = ((_r << 1) ^ 0x04C11DB7 if _r & 0x80000000 else _r << 1) & 0xFFFFFFFF
    _CRC[_i] = _r


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(_CRC[(c >> 24) ^ b])
    return c


def packets(data: bytes) -> np.ndarray:
    """The packets as rows. Sync holds from packet to packet; once lost, the next sync byte that another one follows a packet later (or the end) starts anew."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) % PACKET == 0 and len(raw) and (raw[::PACKET] == 0x47).all():
        return raw.reshape(-1, PACKET)
    rows, at, held = [], 0, False
    while at + PACKET <= len(raw):
        if raw[at] == 0x47 and (held or at + PACKET >= len(raw) or raw[at + PACKET] == 0x47):
            rows.append(raw[at : at + PACKET])
            at, held = at + PACKET, True
        else:
            held = False
            nxt = np.flatnonzero(raw[at + 1 :] == 0x47)
            nxt = [x for x in (nxt[:4096] + at + 1).tolist() if x + PACKET >= len(raw) or raw[x + PACKET] == 0x47] if len(nxt) else []
            at = nxt[0] if nxt else (at + PACKET if not len(np.flatnonzero(raw[at + 1 :] == 0x47)) else at + 4096)
    return np.stack(rows) if rows else np.zeros((0, PACKET), np.uint8)


class Parsed:
    """Header fields of all packets."""

    def __init__(self, p: np.ndarray):
        self.p = p
        self.bad = (p[:, 1] & 0x80) > 0
        self.start = (p[:, 1] & 0x40) > 0
        self.pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
        self.scrambled = (p[:, 3] & 0xC0) > 0
        self.has_payload = (p[:, 3] & 0x10) > 0
        adapt = (p[:, 3] & 0x20) > 0
        self.cc = p[:, 3] & 0x0F
        length = np.where(adapt, p[:, 4].astype(np.int32), -1)
        flags = np.where(length > 0, p[:, 5], 0)
        self.jump = (flags & 0x80) > 0
        self.access = (flags & 0x40) > 0
        self.begin = np.minimum(5 + length, PACKET)

    def payload(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The payload bytes of these packets end to end, and where each packet's begin."""
        mask = np.arange(PACKET) >= self.begin[rows][:, None]
        return self.p[rows][mask], np.r_[0, np.cumsum(PACKET - self.begin[rows])]


def _sections(x: Parsed, pid: int) -> list[bytes]:
    rows = np.flatnonzero((x.pid == pid) & x.has_payload & ~x.bad)
    out, held = [], bytearray()
    for r in rows:
        body = x.p[r, x.begin[r] :].tobytes()
        if x.start[r]:
            if not body:
                continue
            skip = 1 + body[0]
            held += body[1:skip] if held else b""
            out += _take(held)
            held = bytearray(body[skip:])
        elif held:
            held += body
        out += _take(held)
    return out


def _take(held: bytearray) -> list[bytes]:
    done = []
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) < size:
            return done
        section = bytes(held[:size])
        del held[:size]
        if size >= 12 and crc32_mpeg(section) == 0:
            done.append(section)
    if held and held[0] == 0xFF:
        held.clear()
    return done


def programs(x: Parsed) -> dict[int, tuple[int, int]]:
    """Elementary PIDs with (program number, stream type); of several table versions the last one counts."""
    maps: dict[int, int] = {}
    for s in _sections(x, 0):
        if s[0] == 0x00:
            for i in range(8, len(s) - 4, 4):
                number = s[i] << 8 | s[i + 1]
                if number:
                    maps[(s[i + 2] & 0x1F) << 8 | s[i + 3]] = number
    found: dict[int, tuple[int, int]] = {}
    for pid in maps:
        for s in _sections(x, pid):
            if s[0] == 0x02:
                at = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while at + 5 <= len(s) - 4:
                    found[(s[at + 1] & 0x1F) << 8 | s[at + 2]] = (s[3] << 8 | s[4], s[at])
                    at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])
    return found


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(data: bytes | None) -> list[tuple]:
    """(program, pid, stream_type, pes_index, stream_id, pts, dts, random_access, discontinuity, complete, payload) per PES packet."""
    x = Parsed(packets(data or b""))
    out = []
    for pid, (program, kind) in sorted(programs(x).items()):
        rows = np.flatnonzero((x.pid == pid) & x.has_payload & ~x.bad & ~x.scrambled)
        if not len(rows):
            continue
        cc = x.cc[rows].astype(np.int16)
        same = np.r_[False, (cc[1:] == cc[:-1]) & ~x.jump[rows[1:]]]
        # A packet sent twice counts once; only an equal packet is a repetition.
        for i in np.flatnonzero(same):
            same[i] = np.array_equal(x.p[rows[i], x.begin[rows[i]] :], x.p[rows[i - 1], x.begin[rows[i - 1]] :])
        rows = rows[~same]
        cc = x.cc[rows].astype(np.int16)
        broken = np.r_[False, (cc[1:] != (cc[:-1] + 1) % 16) & ~x.jump[rows[1:]]]
        first = np.flatnonzero(x.start[rows])
        if not len(first):
            continue
        body, at = x.payload(rows)
        lost = np.r_[0, np.cumsum(broken)]
        for n, (a, b) in enumerate(zip(first, np.r_[first[1:], len(rows)])):
            pes = body[at[a] : at[b]].tobytes()
            if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
                continue
            size = pes[4] << 8 | pes[5]
            # A gap at the packet that starts this one belongs to what went before.
            gap = bool(lost[b] - lost[a + 1])
            flags, head = pes[7] >> 6, 9 + pes[8]
            pts = _stamp(pes[9:14]) if flags & 2 and len(pes) >= 14 else None
            dts = _stamp(pes[14:19]) if flags == 3 and len(pes) >= 19 else pts
            payload = pes[head : 6 + size] if size else pes[head:]
            out.append((program, pid, kind, n, pes[3], pts, dts, bool(x.access[rows[a]]), gap or bool(broken[a]), not gap and (not size or len(pes) >= 6 + size), payload))
    return out


def _demux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in text_slices(batches, "ts"):
        for id_, data in zip(batch.column("id").to_pylist(), batch.column("ts").to_pylist()):
            for row in demux(data):
                held.append((id_, *row))
                size += len(row[-1])
                if size > FLUSH:
                    yield _batch(held)
                    held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def demultiplex(media: DataFrame, id_column: str, ts_column: str) -> DataFrame:
    """One row per PES packet of each stream in a binary column, in the columns of ``DDL``.

    ``pts`` and ``dts`` are in units of 1/90,000 s (null where absent; a missing dts is the pts).
    ``random_access`` is the indicator on the packet that begins the PES packet.
    ``discontinuity`` says that packets are missing within it or right before it (the
    indicator in the stream excuses a jump); ``complete``, that none are missing within it and
    its announced length was met. Repeated packets count once; packets with the error bit, and
    scrambled ones, are missing ones. Streams that are null, empty or without tables give no
    rows; bytes between lost and regained sync are skipped. Repeated rows are handled each on
    its own. Extra columns are ignored.
    """
    rows = narrow(media, id_column, ts_column).toDF("id", "ts").select(F.col("id").cast("bigint"), "ts")
    return rows.where("ts is not null").mapInArrow(_demux, DDL)


# --- a multiplexer, for tables without media columns ---------------------------------------


def _packetise(pid: int, body: bytes, cc: int, access: bool) -> tuple[np.ndarray, int]:
    """A PES packet or section as packets: full ones, and the last one stuffed by its adaptation field."""
    lead = 2 if access else 0  # an adaptation field of flags on the first packet
    first = min(len(body), PACKET - 4 - lead)
    rest = len(body) - first
    n = 1 + -(-rest // (PACKET - 4))
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, pid >> 8, pid & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (cc + np.arange(n)) % 16
    data = np.frombuffer(body, dtype=np.uint8)
    sizes = [first] + [PACKET - 4] * (n - 1)
    if rest:
        sizes[-1] = rest - (PACKET - 4) * (n - 2)
    full = (n - 2) * (PACKET - 4)
    if full > 0:
        out[1 : n - 1, 4:] = data[first : first + full].reshape(-1, PACKET - 4)
    for i in {0, n - 1}:
        gap = PACKET - 4 - sizes[i]
        if gap:
            out[i, 3] |= 0x20
            out[i, 4] = gap - 1
            if gap > 1:
                out[i, 5] = 0x40 if access and i == 0 else 0
        out[i, PACKET - sizes[i] :] = data[:first] if i == 0 else data[len(data) - sizes[i] :]
    return out, (cc + n) % 16


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")


def _time(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


_TABLES = (_section(0x00, 1, bytes([0, 1, 0xE1, 0x00])), _section(0x02, 1, bytes([0xE1, 0x01, 0xF0, 0, 0x1B, 0xE1, 0x01, 0xF0, 0, 0x06, 0xE1, 0x02, 0xF0, 0])))


def mux(video: list[bytes], data: list[bytes]) -> bytes:
    """A stream of program 1: units on PID 0x101 (every 8th a random access point, 3,600 ticks apart, dts 3,600 before pts) and on PID 0x102 (pts only)."""
    out, cc = [], {0: 0, 0x100: 0, 0x101: 0, 0x102: 0}
    for pid, section in ((0, _TABLES[0]), (0x100, _TABLES[1])):
        p, cc[pid] = _packetise(pid, section, cc[pid], False)
        if len(section) < PACKET - 4:  # tables are padded by 0xFF, not by an adaptation field
            p = np.full((1, PACKET), 0xFF, np.uint8)
            p[0, :4] = [0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10]
            p[0, 4 : 4 + len(section)] = np.frombuffer(section, np.uint8)
        out.append(p)
    for i in range(max(len(video), len(data))):
        for pid, sid, units in ((0x101, 0xE0, video), (0x102, 0xBD, data)):
            if i < len(units):
                pts = 90_000 + 3_600 * (i + 1)
                head = _time(3, pts) + _time(1, pts - 3_600) if pid == 0x101 else _time(2, pts)
                body = bytes([0x80, 0xC0 if pid == 0x101 else 0x80, len(head)]) + head + units[i]
                size = len(body) if len(body) < 65536 else 0
                p, cc[pid] = _packetise(pid, bytes([0, 0, 1, sid, size >> 8, size & 0xFF]) + body, cc[pid], pid == 0x101 and i % 8 == 0)
                out.append(p)
    return np.concatenate(out).tobytes()


UNIT_CHARS = 3000


def _mux_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "html"):
        out = []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            units = [html[i : i + UNIT_CHARS].encode("utf-8", "surrogatepass") for i in range(0, len(html), UNIT_CHARS)] if html else []
            out.append(mux(units, [url.encode("utf-8", "surrogatepass")] if url else []))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], names=["page_id", "ts"])


def page_streams(pages: DataFrame) -> DataFrame:
    """``page_id, ts``: each page as a transport stream, units of UNIT_CHARS characters of html on one PID and the url on another."""
    return narrow(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("bigint")).mapInArrow(_mux_pages, "page_id bigint, ts binary")
