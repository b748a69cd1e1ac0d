from __future__ import annotations

import gzip
import io
import json
import zipfile

import pytest

from sluicebox.llm.warczip import package, read_packages, write_packages

GOOD = [(i, f"https://a.example/{i}", f"<p>page {i} " + "wörd " * (i * 40)) for i in range(12)]


def record(url, body, http="", kind="response", cut=0):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{http}\r\n".encode() + body if kind == "response" else body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:{url}>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    return (head + block + b"\r\n\r\n")[: None if not cut else -cut]


def zipped(members, methods=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data, (methods or {}).get(name, zipfile.ZIP_STORED))
    return out.getvalue()


def index(entries, name="data.warc.gz"):
    return "\n".join(f"{u} 2026 " + json.dumps({"offset": str(o), "length": str(n), "filename": name}) for u, o, n in entries)


@pytest.fixture
def read(spark, tmp_path):
    def of(*packages):
        for k, data in enumerate(packages):
            (tmp_path / f"{k}.wacz").write_bytes(data)
        uris = [(f"file://{tmp_path}/{k}.wacz", "mine") for k in range(len(packages))] + [(None, "x")]
        return read_packages(spark.createDataFrame([*uris, uris[0]], "uri string, member string")).collect()

    return of


def bodies(rows):
    return sorted((r.url, r.payload.decode()) for r in rows if r.error is None)


WANT = sorted((u, h) for _, u, h in GOOD)


def test_indexed_records(read):
    rows = read(package(GOOD))
    assert bodies(rows) == WANT and len(rows) == len(GOOD)
    assert {(r.status, r.mime, r.record_type) for r in rows} == {(200, "text/html", "response")}


def test_zip64_directories(read, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = package(GOOD)
    assert b"PK\x06\x06" in data
    assert bodies(read(data)) == WANT


def test_a_corrupt_record_is_a_row_and_the_rest_is_read(read):
    records = [gzip.compress(record(f"u{i}", b"body %d" % i)) for i in range(4)]
    records[1] = records[1][:20] + b"\xff\xfe\xfd" + records[1][23:]
    at, lines = 0, []
    for i, r in enumerate(records):
        lines.append((f"u{i}", at, len(r)))
        at += len(r)
    rows = read(zipped({"archive/data.warc.gz": b"".join(records), "indexes/index.cdx": index(lines)}))
    assert bodies(rows) == [(f"u{i}", f"body {i}") for i in (0, 2, 3)]
    (bad,) = [r for r in rows if r.error]
    assert bad.member == "archive/data.warc.gz" and bad.payload is None and bad.url is None


def test_a_range_that_is_too_short_and_one_beyond(read):
    r = gzip.compress(record("u", b"body"))
    rows = read(zipped({"archive/data.warc.gz": r, "indexes/index.cdx": index([("u", 0, len(r) - 9), ("v", 5, len(r)), ("w", -1, 3), ("x", 3, 0)])}))
    assert [(x.url, x.error is None) for x in rows] == [(None, False)]


def test_broken_index_lines_are_passed_over(read):
    r = gzip.compress(record("u", b"body"))
    text = "no json here\nx 1 {broken\ny 2 {\"offset\": 3}\n" + index([("u", 0, len(r)), ("u", 0, len(r)), ("q", 0, 5)]) + "\n" + index([("z", 0, 5)], "other.warc.gz")
    assert bodies(read(zipped({"archive/data.warc.gz": r, "indexes/index.cdx.gz": gzip.compress(text.encode())}))) == [("u", "body")]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("gz", [True, False])
def test_archives_that_no_index_names_and_deflated_ones(read, method, gz):
    records = [record(f"u{i}", b"x" * 700_000 + b"%d" % i) for i in range(5)]
    name = "archive/plain.warc" + ".gz" * gz
    data = b"".join(map(gzip.compress, records)) if gz else b"".join(records)
    rows = read(zipped({name: data}, {name: method}))
    assert [(r.url, r.payload[-1:]) for r in sorted(rows, key=lambda r: r.record_offset)] == [(f"u{i}", b"%d" % i) for i in range(5)]


@pytest.mark.parametrize("gz", [True, False])
def test_an_archive_that_is_cut_off(read, gz):
    records = [record(f"u{i}", b"body %d" % i) for i in range(3)]
    data = b"".join(map(gzip.compress, records)) if gz else b"".join(records)
    rows = read(zipped({"archive/a.warc" + ".gz" * gz: data[:-30]}))
    assert bodies(rows) == [("u0", "body 0"), ("u1", "body 1")] and sum(r.error is not None for r in rows) == 1


def test_chunks_and_encodings(read):
    chunked = b"4\r\nWiki\r\n5;x=y\r\npedia\r\n0\r\n\r\n"
    rows = [("c", record("c", chunked, "Transfer-Encoding: chunked\r\n")), ("g", record("g", gzip.compress(b"packed"), "Content-Encoding: gzip\r\n")), ("b", record("b", b"not gzip", "Content-Encoding: gzip\r\n")), ("i", record("i", b"a: b", kind="warcinfo"))]
    got = read(zipped({"archive/a.warc": b"".join(r for _, r in rows)}))
    assert bodies(got) == [("c", "Wikipedia"), ("g", "packed"), ("i", "a: b")]
    assert [r.error[:11] for r in got if r.error] == ["BadGzipFile"]


def test_what_is_no_package(read):
    rows = read(b"nothing", b"", package(GOOD), package(GOOD)[:-300])
    assert bodies(rows) == WANT
    assert sorted(r.uri[-6:] for r in rows if r.error) == ["0.wacz", "1.wacz", "3.wacz"]


def test_round_trip_of_a_table(spark):
    pages = [*GOOD, (None, "n", "null id"), (5, None, "x"), (6, "y", None), (7, "z", ""), (8, "long", "z" * 3_000_000), *GOOD[:2]]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    rows = read_packages(write_packages(df)).collect()
    assert bodies(rows) == sorted((u, h) for _, u, h in pages if u is not None and h is not None)
    assert len(rows) == len(bodies(rows))
    none = spark.createDataFrame([], df.schema)
    assert read_packages(write_packages(none)).collect() == []
