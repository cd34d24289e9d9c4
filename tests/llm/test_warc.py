from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter

import pandas as pd
import pytest

from pulltally.llm import warc
from pulltally.llm.shipping import ship_package

PAGES = "page_id long, url string, html string, digest int, payload string, target long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2) for i, u, h in rows], PAGES)


def test_round_trip(spark, tmp_path):
    ship_package(spark)
    big = "x" * 200_000
    rows = [
        (1, "u", big), (2, "u", big), (3, None, None), (4, "a b\r\nX: y", "é" * 70_000), (None, "z", big), (None, "z", "q" * 2000), (None, "z", "q" * 2000),
        (7, "k", "s" * 999), (8, "k", "s" * 999), (2, "u", big), (9, "k", "t" * 1000), (10, "k", "t" * 1000), (11, "k", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n"), (12, "k", ""), (None, "k", None),
        *((k, "v", str(k) * 90_000) for k in range(20, 30)),
    ]
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages(spark, rows), path)
    found = warc.read_archives(spark, path).collect()
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        target = last.get(h) if len(raw) >= 1000 and last.get(h) != i else None
        want[i, "response" if target is None else "revisit", target, len(raw), hashlib.sha1(raw).hexdigest()] += 1
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found) == want
    assert all(r["error"] is None for r in found)
    payloads = {r["payload_digest"]: bytes(r["payload"]) for r in found if r["payload"] is not None}
    assert all(hashlib.sha1(p).hexdigest() == d for d, p in payloads.items())


def test_empty(spark, tmp_path):
    ship_package(spark)
    warc.write_archives(pages(spark, []), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("size", [0, 1, warc.CHUNK, warc.CHUNK + 1])
def test_chunks(size):
    payload = b"\r\n" * size
    assert warc.unchunked(warc.chunked(payload)) == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabc\r\n", b"3\r\nabcX\r\n0\r\n\r\n"])
def test_broken_chunks(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)


def test_extensions():
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"


def segments(numbers, total):
    block = b"HTTP/1.1 200 OK\r\n\r\nabcdef"
    digest = hashlib.sha1(b"abcdef").hexdigest()
    parts = {1: block[:10], 2: block[10:20], 3: block[20:]}
    return pd.DataFrame({
        "part_origin": "o", "part_number": numbers, "part_total": [total if n == 3 else None for n in numbers],
        "part_file": "f", "part_offset": [100 * n for n in numbers],
        "part_page_id": [5.0 if n == 1 else None for n in numbers], "part_digest": [digest if n == 1 else None for n in numbers], "part_block": [parts[n] for n in numbers],
    })


def test_reassembly_checks():
    assert warc.reassemble(segments([3, 1, 2], 25)).iloc[0]["payload"] == b"abcdef"
    assert "missing" in warc.reassemble(segments([1, 3], 25)).iloc[0]["error"]
    assert "missing" in warc.reassemble(segments([1, 2, 2, 3], 25)).iloc[0]["error"]
    assert "length" in warc.reassemble(segments([1, 2, 3], 24)).iloc[0]["error"]
    assert "length" in warc.reassemble(segments([1, 2], 25)).iloc[0]["error"]


RECORD = b"".join(warc.page_records("0-0", 1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None))


def test_damaged_records_are_rows_and_reading_goes_on():
    assert [(at, h["warc-type"], e) for at, h, _, e in warc.parse(RECORD * 2)] == [(0, "response", None), (len(RECORD), "response", None)]
    for broken, errors in (
        (RECORD[:-3], ["a WARC record is cut off"]), (b"x" + RECORD, ["not a WARC record"]), (RECORD[:40], ["not a WARC record"]),
        (b"junk\r\n" + RECORD, ["not a WARC record", None]), (RECORD[:-30] + RECORD, ["a WARC record is cut off"]),
        (RECORD[:-30] + b"\r\n" + RECORD + RECORD, ["a WARC record is cut off", None, None]),
        (RECORD.replace(b"Content-Length: ", b"Content-Length: x") + RECORD, ["a WARC record has no length", None]),
    ):
        assert [e for *_, e in warc.parse(broken)] == errors


def foreign():
    """Records as other writers make them: own identifiers, base 32 digests, no chunks, other types."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"<p>hi</p>").digest()).decode()
    return [
        warc._record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>")], b"software: x"),
        warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Payload-Digest", digest)], block),
        warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>")], block),
        warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:4>"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)], block),
        warc._record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:5>"), ("WARC-Refers-To", "<urn:uuid:2>"), ("WARC-Payload-Digest", digest)], b""),
        warc._record([("WARC-Type", "response")], block),
    ]


def test_foreign_and_gzip_archives(spark, tmp_path):
    ship_package(spark)
    records = foreign()
    members = [gzip.compress(r) for r in records]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "c.warc.gz").write_bytes(members[1] + members[2][:-12] + members[1])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(b"".join(records * 300)))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    found = Counter((r["file"][-9:], r["record_id"], r["record_type"], r["page_id"], r["payload"] and bytes(r["payload"]), r["error"]) for r in rows)
    wrong = "the payload doesn't have the stated digest"
    page = b"<p>hi</p>"
    want = [("<urn:uuid:2>", "response", None, page, None), ("<urn:uuid:3>", "response", None, page, None), ("<urn:uuid:4>", "response", None, page, wrong),
            ("<urn:uuid:5>", "revisit", None, None, None), (None, "response", None, page, None)]
    assert {k[1:]: n for k, n in found.items() if k[0].endswith("a.warc")} == {w: 1 for w in want}
    assert {k[1:]: n for k, n in found.items() if k[0].endswith("b.warc.gz")} == {w: 1 for w in want}
    assert {k[1:]: n for k, n in found.items() if k[0].endswith("e.warc.gz")} == {w: 300 for w in want}
    damaged = {k[1:]: n for k, n in found.items() if k[0].endswith("c.warc.gz")}
    assert damaged[want[0]] == 2 and any(k[-1] and "gzip" in k[-1] for k in damaged)
    offsets = sorted(r["offset"] for r in rows if r["file"].endswith("b.warc.gz"))
    assert offsets == [sum(map(len, members[:k])) for k in range(1, 6)]
