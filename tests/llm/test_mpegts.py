from __future__ import annotations

import random

import pytest

from sluicebox.llm.mpegts import PACKET, crc32_mpeg, demultiplex, demux, mux, page_streams

VIDEO = [bytes([65 + i % 26]) * (100 + 37 * i) for i in range(20)]
DATA = [f"caption {i}".encode() for i in range(5)]
STREAM = mux(VIDEO, DATA)


def packets(stream):
    return [stream[i : i + PACKET] for i in range(0, len(stream), PACKET)]


def pid(p):
    return (p[1] & 0x1F) << 8 | p[2]


def units(rows, which=0x101):
    return [r for r in rows if r[1] == which]


def test_round_trip():
    rows = demux(STREAM)
    video, data = units(rows), units(rows, 0x102)
    assert [r[-1] for r in video] == VIDEO and [r[-1] for r in data] == DATA
    assert [r[3] for r in video] == list(range(20)) and {r[0] for r in rows} == {1}
    assert {r[2] for r in video} == {0x1B} and {r[2] for r in data} == {0x06}
    assert [r[5] for r in video] == [90_000 + 3_600 * (i + 1) for i in range(20)] and all(r[6] == r[5] - 3_600 for r in video)
    assert all(r[6] == r[5] for r in data)
    assert [r[7] for r in video] == [i % 8 == 0 for i in range(20)]
    assert not any(r[8] for r in rows) and all(r[9] for r in rows)


def test_a_lost_packet_is_a_discontinuity_of_its_unit_alone():
    ps = packets(STREAM)
    own = [i for i, p in enumerate(ps) if pid(p) == 0x101]
    starts = [i for i in own if ps[i][1] & 0x40]
    lost = next(i for i in own if i > starts[10] and i < starts[11])
    rows = units(demux(b"".join(p for i, p in enumerate(ps) if i != lost)))
    assert [r[-1] for r in rows if r[3] != 10] == VIDEO[:10] + VIDEO[11:]
    assert [(r[8], r[9]) for r in rows] == [(i == 10, i != 10) for i in range(20)]
    assert len(rows[10][-1]) < len(VIDEO[10])


def test_a_lost_start_takes_its_unit():
    ps = packets(STREAM)
    starts = [i for i, p in enumerate(ps) if pid(p) == 0x101 and p[1] & 0x40]
    rows = units(demux(b"".join(p for i, p in enumerate(ps) if i != starts[3])))
    payloads = [r[-1] for r in rows]
    assert VIDEO[3] not in payloads and payloads[3:] == VIDEO[4:]
    assert rows[2][8] and not rows[2][9]  # what follows the loss seems to be the unit's before


def test_repeated_packets_count_once():
    ps = packets(STREAM)
    twice = b"".join(p + p if i % 3 == 0 else p for i, p in enumerate(ps))
    assert demux(twice) == demux(STREAM)


@pytest.mark.parametrize("flag", ["error", "scrambled"])
def test_packets_with_errors_and_scrambled_ones_are_missing(flag):
    ps = packets(STREAM)
    own = [i for i, p in enumerate(ps) if pid(p) == 0x101 and not p[1] & 0x40]
    bad = bytearray(ps[own[20]])
    if flag == "error":
        bad[1] |= 0x80
    else:
        bad[3] |= 0xC0
    changed = b"".join(ps[: own[20]]) + bytes(bad) + b"".join(ps[own[20] + 1 :])
    assert demux(changed) == demux(b"".join(ps[: own[20]] + ps[own[20] + 1 :]))


def test_sync_is_found_again():
    ps = packets(STREAM)
    rng = random.Random(5)
    noise = bytes(rng.choice([x for x in range(256) if x != 0x47]) for _ in range(777))
    whole = demux(STREAM)
    assert demux(noise + STREAM) == whole
    assert demux(STREAM + noise[:100]) == whole
    cut = len(ps) // 2
    assert demux(b"".join(ps[:cut]) + noise + b"".join(ps[cut:])) == whole
    with_sync = noise[:50] + b"\x47" + noise[51:90]  # a sync byte that no other one follows
    assert demux(b"".join(ps[:cut]) + with_sync + b"".join(ps[cut:])) == whole


def test_an_announced_jump_is_no_discontinuity():
    ps = packets(STREAM)
    first = next(i for i, p in enumerate(ps) if pid(p) == 0x101 and p[1] & 0x40 and p[3] & 0x20 and p[4] > 0 and i > 30)
    rest, shift = [], 5
    for i, p in enumerate(ps):
        q = bytearray(p)
        if i >= first and pid(p) == 0x101:
            q[3] = q[3] & 0xF0 | (q[3] + shift) & 0x0F
            if i == first:
                q[5] |= 0x80
        rest.append(bytes(q))
    assert demux(b"".join(rest)) == demux(STREAM)


def test_broken_tables_and_streams_without_tables():
    ps = packets(STREAM)
    broken = bytearray(ps[1])
    broken[20] ^= 0xFF  # the map's check sum fails
    assert demux(ps[0] + bytes(broken) + b"".join(ps[2:])) == []
    assert demux(b"".join(ps[2:])) == demux(b"") == demux(None) == demux(b"\x00" * 500) == demux(b"\x47") == []
    assert crc32_mpeg(b"123456789") == 0x0376E6E7


def test_tables_in_the_middle_and_repeated():
    ps = packets(STREAM)
    assert demux(b"".join(ps[2:10] + ps[:2] + ps[10:])) == demux(STREAM)


def test_over_a_table(spark):
    rows = [(1, STREAM, "x"), (None, STREAM, "y"), (2, None, "z"), (3, b"", "z"), (4, b"\x00\x01", "z"), (1, STREAM, "x")]
    df = spark.createDataFrame(rows, "id bigint, ts binary, pid string")
    got = demultiplex(df, "id", "ts").collect()
    one = demux(STREAM)
    assert len(got) == 3 * len(one)
    assert sorted(str((*tuple(r)[1:-1], bytes(r.payload))) for r in got if r.id is None) == sorted(map(str, one))
    none = spark.createDataFrame([], df.schema)
    assert demultiplex(none, "id", "ts").collect() == []


def test_pages_come_back(spark):
    pages = [(1, "https://a.example/é", "<p>" + "wörd " * 5000), (2, "u", ""), (3, None, "x"), (4, "", None), (None, "v", "w"), (1, "u", "🙂" * 4000)]
    streams = page_streams(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    rows = demultiplex(streams, "page_id", "ts").collect()
    html = {}
    for r in sorted((r for r in rows if r.pid == 0x101), key=lambda r: r.pes_index):
        html.setdefault(r.id, []).append(r.payload.decode())
    assert "".join(html[3]) == "x" and "".join(html[None]) == "w"
    assert sorted(len(x) for x in html[1]) == sorted([*[3000] * 9, 1003, 1000])
    assert sorted(r.payload.decode() for r in rows if r.pid == 0x102) == sorted(["https://a.example/é", "u", "v", "u"])
