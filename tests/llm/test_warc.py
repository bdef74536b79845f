import hashlib
import random

from relfeat.llm import warc

from .conftest import CLASH, CLASH_VALUES


def pages():
    rnd = random.Random(2)
    same = "é" * 700
    rows = [(i, f"http://h{i}.org/x", "".join(rnd.choice("aé\r\n <>0") for _ in range(rnd.choice([0, 10, 900, 9000])))) for i in range(40)]
    rows += [(100 + i, None, same) for i in range(5)] + [(200, "u\r\nv", "short"), (201, "u", "short")]
    rows += [(300, "u", None), (301, "u", ""), (None, "u", same), (None, None, None), (302, "u", "0\r\n\r\nWARC/1.1\r\n\r\n" * 5000),
             (104, None, same), (303, "u", "x" * 400_000)]
    return rows


def expected(rows):
    best, out = {}, []
    for i, _, h in rows:
        best.setdefault(h or "", []).append(i)
    for i, _, h in rows:
        h = h or ""
        data = h.encode()
        ids = [x for x in best[h] if x is not None]
        top = max(ids) if len(data) >= 1000 and len(best[h]) > 1 and ids else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), *(("response", None) if top is None or i == top else ("revisit", top))))
    return sorted(out, key=str)


def number(x):
    return int(x) if x else None


def test_round_trip_with_segments(spark, tmp_path):
    rows = pages()
    frame = spark.createDataFrame([r + CLASH_VALUES[:1] + CLASH_VALUES[2:] for r in rows],
                                  "page_id long, url string, html string, " + CLASH.replace("size string, ", ""))
    warc.write_warc(frame.repartition(4), str(tmp_path / "a"), segment_bytes=2048, records_per_file=16)
    records = warc.read_warc(spark, str(tmp_path / "a")).cache()
    assert records.where("NOT valid").count() == 0
    got = sorted(((number(r.key), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in warc.page_digests(records).collect()), key=str)
    assert got == expected(rows)
    payloads = {number(r.key): bytes(r.payload).decode() for r in records.where("type = 'response' AND key <> ''").collect()}
    assert payloads[302] == rows[[r[0] for r in rows].index(302)][2]
    warc.write_warc(frame, str(tmp_path / "z"), compression="gzip", broadcast_payloads=0)
    again = sorted(((number(r.key), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in
                    warc.page_digests(warc.read_warc(spark, str(tmp_path / "z"))).collect()), key=str)
    assert again == got


def test_broken_segments_are_told(spark, tmp_path):
    def archive(name, change):
        records = change(warc.page_records(1, "u", b"y" * 9000, None, 1000))
        (tmp_path / name).write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
        return warc.read_warc(spark, str(tmp_path / name)).collect()

    whole = archive("whole.warc", lambda r: r[::-1])  # order in the file does not matter
    assert whole[0].valid and bytes(whole[0].payload) == b"y" * 9000
    assert not archive("gap.warc", lambda r: r[:3] + r[4:])[0].valid
    assert not archive("no_end.warc", lambda r: r[:-1])[0].valid
    assert not archive("twice.warc", lambda r: r + r[2:3])[0].valid
    headless = archive("no_start.warc", lambda r: r[1:])
    assert [(r.record_id, r.type, r.payload, r.valid) for r in headless] == [(warc.page_id_of(1), None, None, False)]
    cut = archive("cut.warc", lambda r: r[:-1] + [r[-1][:-5]])
    assert [(r.valid, r.payload) for r in cut] == [(False, None)]


def test_malformed_headers_fail_no_task(spark, tmp_path):
    good = warc.page_records(2, "u", b"fine", None, 1000)[0]
    bad = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: many\r\n\r\nabc", b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nWARC-Segment-Number: x\r\nContent-Length: 3\r\n\r\nabc",
           b"WARC/1.1\r\n\xff\xfe: 1\r\nWARC-Record-ID: <c>\r\nWARC-Segment-Total-Length: -\r\nContent-Length: 3\r\n\r\nabc"]
    (tmp_path / "bad.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [*bad, good]) + b"WARC/1.1\r\nWARC-Type: resp")
    got = sorted(((r.record_id, r.valid, r.payload and bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path / "bad.warc")).collect()), key=str)
    assert got == sorted([("<a>", False, None), ("<b>", False, None), ("<c>", False, None), (warc.page_id_of(2), True, b"fine"), (None, False, None)], key=str)
    (tmp_path / "cut.warc").write_bytes(good[:-2])
    assert [r.valid for r in warc.read_warc(spark, str(tmp_path / "cut.warc")).collect()] == [False]


def test_chunked_framing():
    for payload in (b"", b"a", "é".encode() * 9000, b"\r\n0\r\n\r\n"):
        assert warc.dechunk(warc.http_block(payload)) == payload
    assert warc.dechunk(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.dechunk(head + b"5;ext=1\r\nhello\r\n0\r\n\r\n") == b"hello"
    for broken in (b"5\r\nhel", b"zz\r\nhello\r\n0\r\n\r\n", b"5\r\nhello\r\n", b"5\r\nhelloXX0\r\n\r\n"):
        assert warc.dechunk(head + broken) is None
    assert warc.dechunk(b"no header") is None


def test_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.page_digests(warc.read_warc(spark, str(tmp_path / "e"))).count() == 0
