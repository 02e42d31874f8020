import base64
import hashlib

import pytest
from pathloom.llm import queries, warc


def brute(rows):
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    seen, out = set(), []
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        again = (html or "") in seen
        seen.add(html or "")
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(queries.op8_warc(spark, sf_dir)) == brute(pages)


ROWS = [(5, "http://a/\r\nX: y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (7, None, None), (8, "u", ""), (None, "u", "only"), (9, "u", "x" * 3_000_000), (10, "u", "only")]


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, sha256 string, uid int")
    got, want = found(warc.archived_pages(spark, pages)), brute(ROWS)
    assert got == want
    assert warc.archived_pages(spark, pages.limit(0)).count() == 0


def read_file(data):
    """Records of a WARC file by lengths alone: header fields and block."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 4 + len(block)
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        out.append((fields, block))
    return out


def test_records_make_a_file(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archive(spark, pages, f"file://{tmp_path}/a", min_revisit_bytes=5, date="2020-01-02T03:04:05Z")
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == len({r[2] or "" for r in ROWS})
    data = b"".join(bytes(r.record) for r in warc.read_records(spark, f"file://{tmp_path}/a").collect())
    records = read_file(data)
    ids = {f["WARC-Record-ID"]: f for f, _ in records}
    assert len(ids) == len(records) == len(ROWS) and all(f["WARC-Date"] == "2020-01-02T03:04:05Z" for f, _ in records)
    for f, block in records:
        if f["WARC-Type"] == "response":
            head, _, payload = block.partition(b"\r\n\r\n")
            assert head.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in head
            assert f["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert f["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert not block and int(f["X-Payload-Length"]) >= 5
            assert ids[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]


def test_damage_is_found():
    head = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <x>\r\nContent-Length: 3\r\n\r\n"
    assert bytes(warc.parse_record(head + b"abc\r\n\r\n")[1]) == b"abc"
    for raw in (head + b"ab\r\n\r\n", head + b"abcd\r\n\r\n", b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1"):
        with pytest.raises(ValueError, match="record|block"):
            warc.parse_record(raw)
