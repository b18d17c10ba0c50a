"""WARC round trip, transactions and revisits."""

import gzip
import hashlib

from lotgrid.llm.warc import archive_round_trip, assemble, parse_records, read_records, write_captures

SCHEMA = "page_id long, url string, html string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        most = max((p for p in same if p is not None), default=None)
        revisit = len(body) >= 1000 and len(same) > 1 and page != most
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", most if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark):
    big, long = "é" * 500, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20_000
    rows = [(1, "http://a.example/p?q=1#f", big), (2, "http://b.example", big), (2, "http://b.example", big), (None, None, big), (3, "bad url\r\nX: y", "small")]
    rows += [(4, "http://c.example/", "small"), (5, "http://d.example/", None), (6, "http://d.example/", ""), (7, "http://e.example/", long), (8, "http://f.example/", long)]
    got = sorted(str(tuple(r)) for r in archive_round_trip(frame(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == brute(rows)


def test_transactions(spark, tmp_path):
    path = str(tmp_path / "warc")
    html = "<p>\r\n\r\nbody</p>\n" * 100
    write_captures(frame(spark, [(9, "http://a.example/x", html), (8, "http://a.example/y", html)]), path, captures_per_file=1)
    records = read_records(spark, path)
    assert records.count() == 6
    captures = {r["main"]["type"]: r for r in assemble(records).collect()}
    response = captures["response"]
    assert response["main"]["payload"] == html and response["main"]["url"] == "http://a.example/x"
    assert response["request"]["http"].startswith("GET /x HTTP/1.1\r\nHost: a.example")
    assert response["metadata"] == [{"pageId": "9", "payloadLength": str(len(html))}]
    assert captures["revisit"]["main"]["payload"] is None and captures["revisit"]["main"]["digest"] == response["main"]["digest"]


def test_parser_takes_other_layouts():
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    for content in (record * 2, gzip.compress(record) + gzip.compress(record), gzip.compress(record * 2)):
        assert [r["fields"] for r in parse_records(content)] == [{"a": "b"}] * 2
    assert list(parse_records(b"")) == []


def test_empty(spark):
    assert archive_round_trip(frame(spark, [])).collect() == []
