"""Web archives packed as ZIP: directories, indexes and records read by ranges.

A package holds ``archive/*.warc.gz`` (stored, so that the archive's own offsets hold within the
ZIP) and ``indexes/*.cdx`` or ``.cdx.gz``. A task reads a package's end record (with its ZIP64
form) and central directory, then the index members; index lines give the range of every
record. The ranges are spread over the cluster, and each record is read by its range alone:
nothing is extracted. Archive members without an index, or compressed ones, are read through.
What can't be read is a row that says why.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import fresh_path, narrow, text_slices, written

#: Pages of a written package.
PACKAGE_PAGES = 2_000
#: Archive bytes that a reading task should have: at least the first number, and no more than the second where there are many.
TASK_BYTES = (16 << 20, 256 << 20)
_RANGES = "uri string, member string, start bigint, length bigint, key string, error string"
_RECORDS = "uri string, member string, record_offset bigint, record_id string, record_type string, url string, date string, status int, mime string, payload binary, error string"
_OUT = pa.schema([("uri", pa.string()), ("member", pa.string()), ("record_offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("mime", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
#: What broken bytes raise.
BROKEN = (ValueError, KeyError, IndexError, EOFError, struct.error, zlib.error, gzip.BadGzipFile, UnicodeDecodeError)


def open_uri(uri: str):  # noqa: ANN201
    """A file open for reads at any offset; any file system that Arrow knows by URI."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)


class Member:
    __slots__ = ("name", "method", "packed", "size", "header", "start")

    def __init__(self, name: str, method: int, packed: int, size: int, header: int):
        self.name, self.method, self.packed, self.size, self.header = name, method, packed, size, header
        self.start = -1


def _at(f, start: int, length: int) -> bytes:  # noqa: ANN001
    return f.read_at(length, start) if length > 0 else b""


def directory(f) -> list[Member]:  # noqa: ANN001
    """The members, from the end record and the central directory (ZIP64 where it is used)."""
    total = f.size()
    tail_at = max(0, total - 65_557)
    tail = _at(f, tail_at, total - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        locator = _at(f, tail_at + end - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            record = _at(f, struct.unpack("<Q", locator[8:16])[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where the locator points")
            count, size, start = struct.unpack("<QQQ", record[32:56])
    central, at, members = _at(f, start, size), 0, []
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", central[at + 8 : at + 12])
        packed, full, n, m, k = struct.unpack("<IIHHH", central[at + 20 : at + 34])
        header = struct.unpack("<I", central[at + 42 : at + 46])[0]
        name = central[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, p = central[at + 46 + n : at + 46 + n + m], 0
        while p + 4 <= len(extra):
            tag, length = struct.unpack("<HH", extra[p : p + 4])
            if tag == 1:
                q = p + 4
                if full == 0xFFFFFFFF:
                    full, q = struct.unpack("<Q", extra[q : q + 8])[0], q + 8
                if packed == 0xFFFFFFFF:
                    packed, q = struct.unpack("<Q", extra[q : q + 8])[0], q + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack("<Q", extra[q : q + 8])[0]
            p += 4 + length
        members.append(Member(name, method, packed, full, header))
        at += 46 + n + m + k
    return members


def locate(f, member: Member) -> int:  # noqa: ANN001
    """Where a member's data begin: the local header has its own lengths of name and extra field."""
    if member.start < 0:
        local = _at(f, member.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {member.name}")
        n, m = struct.unpack("<HH", local[26:30])
        member.start = member.header + 30 + n + m
    return member.start


def _small(f, member: Member) -> bytes:  # noqa: ANN001
    data = _at(f, locate(f, member), member.packed)
    return data if member.method == 0 else zlib.decompress(data, -15)


def index_lines(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of each CDXJ line: sort key, timestamp, JSON."""
    for line in data.decode("utf-8", "replace").splitlines():
        brace = line.find("{")
        if brace >= 0:
            try:
                x = json.loads(line[brace:])
                yield x["filename"], int(x["offset"]), int(x["length"])
            except (ValueError, KeyError, TypeError):
                continue


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            rows: list[tuple] = []
            with open_uri(uri) as f:
                for row in _package_ranges(f):
                    rows.append((uri, *row))
                    if len(rows) >= 10_000:
                        yield _ranges(rows)
                        rows = []
            if rows:
                yield _ranges(rows)


def _package_ranges(f) -> Iterator[tuple]:  # noqa: ANN001
    """(member, start, length, key, error) of each range to read; a key for what an index names."""
    try:
        members = directory(f)
    except BROKEN as e:
        yield None, 0, 0, None, f"no directory: {e}"
        return
    archives: dict[str, Member] = {}
    for m in members:
        if m.name.startswith("archive/") and not m.name.endswith("/"):
            try:
                locate(f, m)
                archives[m.name.rsplit("/", 1)[-1]] = m
            except BROKEN as e:
                yield m.name, m.header, 0, None, f"no member: {e}"
    seen: set[tuple[str, int]] = set()
    indexed: set[str] = set()
    for m in members:
        if not (m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj", ".cdx.gz"))):
            continue
        try:
            data = _small(f, m)
            data = gzip.decompress(data) if m.name.endswith(".gz") else data
        except BROKEN as e:
            yield m.name, m.header, 0, None, f"no index: {e}"
            continue
        for name, offset, length in index_lines(data):
            a = archives.get(name.rsplit("/", 1)[-1])
            if a is None or a.method or (a.name, offset) in seen or offset < 0 or length <= 0 or offset + length > a.size:
                continue
            seen.add((a.name, offset))
            indexed.add(a.name)
            yield a.name, a.start + offset, length, a.name, None
    for a in archives.values():
        if a.name not in indexed:
            yield a.name, a.start, -a.packed if a.method else a.packed, None, None


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    u, m, s, n, k, e = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(m, pa.string()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.string()), pa.array(e, pa.string())], names=["uri", "member", "start", "length", "key", "error"])


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return lines[0], out


def record_size(head: bytes) -> int:
    """The bytes of a record's block by its head; raises for a head that isn't one."""
    if not head.startswith(b"WARC/"):
        raise ValueError("no record")
    size = int(_headers(head)[1].get("content-length") or 0)
    if size < 0:
        raise ValueError("a negative length")
    return size


def parse_record(data: bytes) -> tuple:
    """(id, type, url, date, status, mime, payload) of a WARC record; raises for what isn't one."""
    head_end = data.find(b"\r\n\r\n")
    if head_end < 0:
        raise ValueError("no record")
    size = record_size(data[:head_end])
    head = _headers(data[:head_end])[1]
    block = data[head_end + 4 : head_end + 4 + size]
    if len(block) < size:
        raise ValueError("a record that is cut off")
    status, mime, payload = None, head.get("content-type"), block
    if head.get("warc-type") == "response" and block.startswith(b"HTTP/"):
        at = block.find(b"\r\n\r\n")
        line, http = _headers(block[: at if at >= 0 else len(block)])
        payload = block[at + 4 :] if at >= 0 else b""
        parts = line.split(" ")
        status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() and len(parts[1]) < 10 else None
        mime = http.get("content-type")
        if "chunked" in http.get("transfer-encoding", "").lower():
            payload = _dechunk(payload)
        if http.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
            payload = gzip.decompress(payload)
    return head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), status, (mime or "").split(";")[0].strip() or None, payload


def _dechunk(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        try:
            size = int(data[at:line].split(b";")[0], 16) if line >= 0 else 0
        except ValueError:
            return data
        if not size:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + size])
        at = line + 4 + size


def _walk(data: io.RawIOBase, zipped: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, record bytes) of each record of a whole archive; a gzip member is a record. Raises where it can't go on."""
    if not zipped:
        held, at, more = bytearray(), 0, True

        def fill(n: int) -> bool:
            nonlocal more
            while more and len(held) < n:
                chunk = data.read(1 << 20)
                more = bool(chunk)
                held.extend(chunk)
            return len(held) >= n

        while fill(1):
            size = 1 << 12
            while (end := held.find(b"\r\n\r\n")) < 0 and fill(min(size := size * 2, 1 << 24)):
                pass
            if end < 0:
                raise ValueError("no record")
            whole = end + 4 + record_size(bytes(held[:end])) + 4
            fill(whole)
            yield at, bytes(held[:whole])
            at += whole
            del held[:whole]
        return
    engine, at, begin, parts = zlib.decompressobj(31), 0, 0, []
    while chunk := data.read(1 << 20):
        while chunk:
            parts.append(engine.decompress(chunk))
            used = len(chunk) - len(engine.unused_data)
            at, chunk = at + used, engine.unused_data
            if engine.eof:
                yield begin, b"".join(parts)
                engine, parts, begin = zlib.decompressobj(31), [], at
    if parts:
        raise EOFError("an archive that is cut off")


class _Range(io.RawIOBase):
    """A range of a file as a stream; a deflated member is inflated on the way."""

    def __init__(self, f, start: int, length: int):  # noqa: ANN001
        self.f, self.at, self.stop = f, start, start + abs(length)
        self.engine = zlib.decompressobj(-15) if length < 0 else None

    def read(self, size: int = -1) -> bytes:
        while True:
            take = self.stop - self.at if size < 0 else min(size, self.stop - self.at)
            raw = _at(self.f, self.at, take)
            self.at += len(raw)
            if self.engine is None or not raw:
                return raw
            if out := self.engine.decompress(raw):
                return out


def _found(f, member: str, start: int, length: int, key: str | None) -> Iterator[tuple]:  # noqa: ANN001
    """(offset, id, type, url, date, status, mime, payload, error) of the records of a range."""
    zipped, reached = member.endswith(".gz"), start
    try:
        if key is None:
            found = ((start + o, r) for o, r in _walk(_Range(f, start, length), zipped))
        else:
            raw = _at(f, start, length)
            engine = zlib.decompressobj(31)
            found = [(start, engine.decompress(raw) if zipped else raw)]
            if zipped and not engine.eof:
                raise EOFError("a record that is cut off")
        for reached, record in found:
            try:
                parsed = parse_record(record)
            except BROKEN as e:
                yield (reached, *[None] * 7, f"{type(e).__name__}: {e}")
            else:
                yield (reached, *parsed, None)
    except BROKEN as e:
        yield (reached, *[None] * 7, f"{type(e).__name__}: {e}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_files: dict = {}
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for uri, member, start, length, key, error in zip(*(batch.column(x).to_pylist() for x in ("uri", "member", "start", "length", "key", "error"))):
            if error is not None:
                rows.append((uri, member, start, *[None] * 7, error))
                continue
            if uri not in open_files:
                for f in open_files.values():
                    f.close()
                open_files = {uri: open_uri(uri)}
            for row in _found(open_files[uri], member, start, length, key):
                rows.append((uri, member, *row))
                size += len(row[-2] or b"")
                if size > 2_000_000:
                    yield _records(rows)
                    rows, size = [], 0
    if rows:
        yield _records(rows)
    for f in open_files.values():
        f.close()


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record of the packages named in the column ``uri``, in the columns of ``_RECORDS``.

    ``payload`` is the HTTP body of a response (chunks joined, gzip undone), or the block of any
    other record; ``status`` is null where there is no HTTP head. An index line that is broken,
    names no stored archive member or points beyond it is passed over; a range named twice is
    read once. A member that no index names is read through. ``error`` is null, or says why a
    package, a member, an index or a record can't be read; then the columns of the record are
    null, and other records don't suffer (of a member that is read through, the rest behind the
    last record is one such row, at that record's offset). A file that isn't there raises. Null URIs are passed over,
    repeated ones read once; an empty table gives no rows; extra columns are ignored.
    """
    uris = narrow(packages, "uri").where("uri is not null").distinct()
    ranges = written(uris.mapInArrow(_plan, _RANGES), "ranges")
    total = ranges.agg(F.coalesce(F.sum(F.abs("length")), F.lit(0))).first()[0]
    # By the bytes to be read, which the small rows don't show: a file's ranges within a stretch meet in one task, in order.
    least, most = TASK_BYTES
    width = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(-(-total // least), width), total // most)
    at = F.pmod(F.xxhash64("uri", F.floor(F.col("start") / least)), F.lit(tasks)).cast("int")
    return ranges.repartitionById(tasks, at).sortWithinPartitions("uri", "start").mapInArrow(_read, _RECORDS)


# --- a writer of packages, for tables of pages ---------------------------------------------


def _write(folder: str):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            uri = f"{folder}/part-{part:06d}-{number:04d}.wacz"
            number += 1
            system, path = fs.FileSystem.from_uri(uri)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            # A repeated attempt writes the same bytes; the move makes them visible at once.
            own = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
            with system.open_output_stream(own) as f:
                f.write(package(held))
            system.move(own, path)
            done = pa.RecordBatch.from_pydict({"uri": [uri], "n": pa.array([len(held)], pa.int64())})
            held.clear()
            return done

        for batch in text_slices(batches, "html"):
            for row in zip(*(batch.column(x).to_pylist() for x in ("page_id", "url", "html"))):
                held.append(row)
                if len(held) >= PACKAGE_PAGES:
                    yield close()
        if held:
            yield close()

    return write


def package(pages: list[tuple], level: int = 4) -> bytes:
    """A package of pages (page_id, url, html): the archive stored, its index deflated."""
    archive, lines, at = [], [], 0
    for page_id, url, html in pages:
        body = html.encode("utf-8", "surrogatepass")
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
        name = "" if page_id is None else str(page_id)
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
        record = gzip.compress(head.encode("utf-8", "surrogatepass") + http + body + b"\r\n\r\n", level, mtime=0)
        archive.append(record)
        lines.append(f"{url} 20260101000000 " + json.dumps({"offset": str(at), "length": str(len(record)), "filename": "data.warc.gz", "status": "200", "mime": "text/html"}))
        at += len(record)
    out = io.BytesIO()
    day = (2026, 1, 1, 0, 0, 0)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("archive/data.warc.gz", day), b"".join(archive), zipfile.ZIP_STORED)
        z.writestr(zipfile.ZipInfo("indexes/index.cdx", day), "\n".join(sorted(lines)), zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo("datapackage.json", day), json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_packages(pages: DataFrame) -> DataFrame:
    """Packages of the pages (page_id, url, html; rows with null url or html have no capture) in the shared folder: ``uri, n``."""
    folder = fresh_path(pages.sparkSession, "packages")
    rows = narrow(pages, "page_id", "url", "html").where("url is not null and html is not null").withColumn("page_id", F.col("page_id").cast("bigint"))
    return written(rows.mapInArrow(_write(folder), "uri string, n bigint"), "manifest")
