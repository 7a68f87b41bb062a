import gzip
import hashlib

import pytest

from tests.conftest import SF0001
from vigil.llm import warc
from vigil.llm.queries import op3_warc


def brute(rows):
    first = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    copies = {}
    for _, html in rows:
        copies[(html or "").encode()] = copies.get((html or "").encode(), 0) + 1
    out = []
    for i, html in rows:
        data = (html or "").encode()
        to = first.get(data) if copies[data] > 1 else None
        to = None if to == i else to
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", str(to)))
    return sorted(out)


def got(found):
    return sorted((r.record_id or "None", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "None")
                  for r in found.filter("problem IS NULL").collect())


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>é" * 60
    rows = [(5, "http://a/", long), (3, None, long), (9, "http://b/\r\nX: y", long), (3, "u", long), (None, "u", long), (7, "u", None), (8, "u", ""),
            (11, "u", "short"), (12, "u", "short"), (13, "u", "x" * 99), (14, "u", "x" * 99), (15, "u", "y" * 100), (16, "u", "y" * 100),
            (17, "u", "big\r\n\r\n" * 300_000), (18, "u", "\x00\x1f\x8b")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


def test_round_trip(pages):
    archives = warc.write_archives(pages, archive_bytes=500)
    found = warc.read_archives(archives, with_payload=True)
    assert found.filter("problem IS NOT NULL").count() == 0
    assert got(found) == brute([(r.page_id, r.html) for r in pages.collect()])
    texts = {r.page_id: r.html or "" for r in pages.collect()}
    for r in found.filter("record_type = 'response' AND record_id IS NOT NULL").collect():
        assert bytes(r.payload).decode() == texts[int(r.record_id)]


def test_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF0001}/pages.parquet").collect()]
    found = op3_warc(spark, SF0001).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found) == brute(rows)
    assert all(r.problem is None for r in found)


def test_each_record_is_a_member_and_damage_stays_local():
    digest = hashlib.sha256(b"hello").hexdigest()
    members = [warc.record(i, "http://x/", b"hello", digest, None, "1970-01-01T00:00:00Z", 6) for i in range(4)]
    for m in members:
        assert gzip.decompress(m).startswith(b"WARC/1.1\r\n")
    damaged = bytearray(members[1])
    damaged[-6] ^= 1  # the check sum
    wrong = warc.record(9, "http://x/", b"hello", "0" * 64, None, "1970-01-01T00:00:00Z", 6)
    found = list(warc.records(members[0] + bytes(damaged) + members[2] + wrong + members[3][:-3]))
    assert [f.get("record_id") for f in found if not f["problem"]] == ["0", "2"]
    assert [bool(f["problem"]) for f in found] == [False, True, False, True, True]


def test_files_of_others(spark, tmp_path):
    payload = b"<html>" + b"z" * 200_000
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record))
    rows = warc.read_files(spark, str(tmp_path), with_payload=True).orderBy("position").collect()
    assert [(r.record_type, r.payload_bytes, r.problem) for r in rows] == [("warcinfo", 2, None), ("response", len(payload), None)]
    assert bytes(rows[1].payload) == payload


def test_no_pages(spark, pages):
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
