"""WARC archives: exact round trips and broken archives."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from fieldwarden.llm import archives
from fieldwarden.llm.archives import WarcError, parse_record, read_member, record

SCHEMA = "page_id bigint, url string, html string, payload string"


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 4000)
    long, short = "é" * 60, "x" * 99
    rows = [(4, "http://a/%41\r\n b", long, "c"), (2, "http://b", long, "c"), (2, "http://b", long, "c"), (9, None, None, None),
            (8, "u", "", "c"), (5, "v", short, "c"), (6, "w", short, "c"), (None, "n", long, "c"), (7, "z", "<p>" * 9000, "c")]
    rows += [(100 + i, f"http://h/{i}", f"{i} " * 400, "c") for i in range(40)]
    path = archives.write_warc(archives.with_originals(spark.createDataFrame(rows, SCHEMA)), f"file://{tmp_path}/warc")
    got = archives.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for p, u, h, _ in rows if p == r.page_id and u == r.url)
        revisit = html == long and r.page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert (bytes(r.payload) if r.payload is not None else None) == (None if revisit else html.encode())
    for file in tmp_path.glob("warc/archive=*/part-*"):
        assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n") >= 1


def test_no_pages(spark, tmp_path):
    path = archives.write_warc(archives.with_originals(spark.createDataFrame([], SCHEMA)), f"file://{tmp_path}/warc")
    assert archives.read_warc(spark, path).collect() == []


def test_member_of_sixteen_megabytes_and_more(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab" * (9 << 20), "c"), (2, "v", "z", "c")], SCHEMA)
    path = archives.write_warc(archives.with_originals(df), f"file://{tmp_path}/warc")
    got = archives.read_warc(spark, path, payloads=False).orderBy("page_id").collect()
    assert [r.payload_bytes for r in got] == [18 << 20, 1]


def _read(data):
    body, end = read_member(memoryview(data), 0)
    assert end == len(data)
    return parse_record(body)


def test_damage_is_found():
    whole = record(1, "u", b"payload" * 30, hashlib.sha256(b"payload" * 30).hexdigest(), None)
    assert _read(gzip.compress(whole))[3] == 210
    for broken in (whole.replace(b"payload", b"Payload", 1), whole.replace(b"payload", b"payloaD")):
        with pytest.raises(WarcError):
            _read(gzip.compress(broken))
    for broken in (whole[:-20], whole + b"more"):
        with pytest.raises(WarcError):
            read_member(memoryview(gzip.compress(broken)), 0)
    with pytest.raises(WarcError):
        read_member(memoryview(gzip.compress(whole)[:-30]), 0)
