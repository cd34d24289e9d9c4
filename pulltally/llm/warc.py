"""WARC archives of pages, with long records in segments, and reading them back.

Writing: a page's HTTP response carries its HTML in chunked transfer coding. Blocks over SEGMENT bytes go into a
first record and continuation records (WARC 1.1, section 7). Pages of equal payload become revisits of one of them.
Reading: every file is parsed by itself. Whole records are decoded at once; segments are grouped by the identifier
of their origin, wherever they lie, ordered by segment number and checked against the stated total length, then
decoded. A group is one page's segments. Archives of other writers are read too: any record identifiers, gzip
members, records without digests or sizes. What is damaged becomes a row that says where and why; reading goes on
with the next record that can be found.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally.llm.scratch import Scratch

#: Longest block of a record, in bytes.
SEGMENT = 1 << 16
#: Bytes of a chunk of the transfer coding.
CHUNK = 1 << 13
#: Records are handed to Spark's writer in packs of about this size; a file holds so many packs.
PACK = 4 << 20
PACKS_PER_FILE = 8
#: Bytes of a compressed file handed on at a time.
PIECE = 1 << 15
#: Payloads below this size are stored each time.
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string, record_id string, file string, offset long"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), *[pa.string()] * 4, pa.int64()]
_PARTS = "origin string, number long, total long, page_id long, digest string, block binary, file string, offset long"


def chunked(payload: bytes) -> bytes:
    parts = [payload[i:i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if it's cut off or malformed. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at:at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")


def page_records(uid: str, page_id: int | None, url: str | None, payload: bytes, digest: str, target: int | None) -> Iterator[bytes]:
    """The record of a page, or its segments; target: the page that a revisit refers to."""
    name = f"<urn:page:{'none' if page_id is None else page_id}:{uid}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    if target is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"{name}>"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{target}>"), *common], _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= SEGMENT:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", f"{name}>"), *common], block)
        return
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", f"{name}>"), ("WARC-Segment-Number", "1"), *common], block[:SEGMENT])
    starts = range(SEGMENT, len(block), SEGMENT)
    for number, start in enumerate(starts, 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name}:{number}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Segment-Origin-ID", f"{name}>"), ("WARC-Segment-Number", str(number))]
        if start == starts[-1]:
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(own, block[start:start + SEGMENT])


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def passed() -> pa.RecordBatch:
        # The writer ends each row with CRLF, which is the end of the pack's last record.
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-2]], pa.binary())], ["pack"])

    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "target")]
        for row in zip(*columns, strict=True):
            page_id, url, payload, digest, target = (x.as_py() for x in row)
            for record in page_records(f"{part}-{n}", page_id, url, payload, digest, target):
                held.append(record)
                size += len(record)
                if size >= PACK:
                    yield passed()
                    held, size = [], 0
            n += 1
    if held:
        yield passed()


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes one record for every row of pages (page_id, url, html; null html: empty) to WARC files below path.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, those with the largest page_id are responses and
    the others revisits of it; if all page_ids are null, all are responses. Payloads stay in the task that read them
    unless there are too many groups of copies to broadcast.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    copies = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    copies = Scratch(pages.sparkSession, "warc").save(copies.where("n > 1 and last is not null").select("digest", "last"), "copies")
    target = F.when((F.octet_length("payload") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", target.alias("target"))
    packs = rows.mapInArrow(_packer, "pack binary")
    packs.select(F.col("pack").cast("string").alias("value")).write.option("maxRecordsPerFile", PACKS_PER_FILE).option("lineSep", "\r\n").text(path)


def _members(content: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """Offset, bytes and error of each gzip member; of any other file, all of it."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content, None
        return
    at = 0
    while at < len(content):
        member, parts, fed, error = zlib.decompressobj(31), [], at, None
        try:
            while not member.eof and fed < len(content):  # a piece at a time, as what follows the member is handed back
                parts.append(member.decompress(content[fed:fed + PIECE]))
                fed += PIECE
        except zlib.error:
            error = "a gzip member is damaged"
        else:
            error = None if member.eof else "a gzip member is cut off"
        yield at, b"".join(parts), error
        if error:  # on with the next beginning of a member
            found = content.find(b"\x1f\x8b\x08", at + 1)
            at = len(content) if found < 0 else found
        else:
            at = min(fed, len(content)) - len(member.unused_data)


_BEGINNING = re.compile(rb"(?:(?<=\r\n)|(?<=\n))WARC/\d")


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Offset, headers (names in small letters), block and error of each record.

    After a record that is malformed or cut off, reading goes on with the next line that begins one. In gzip files
    the offset is that of the member.
    """
    packed = content[:2] == b"\x1f\x8b"
    for start, data, error in _members(content):
        at = 0
        while at < len(data):
            problem, headers, block, next_at = _record_at(data, at)
            if problem:
                found = _BEGINNING.search(data, at + 1)
                next_at = found.start() if found else len(data)
            yield start if packed else at, headers, block, problem
            at = next_at
        if error:
            yield start, {}, b"", error


def _record_at(data: bytes, at: int) -> tuple[str | None, dict[str, str], bytes, int]:
    """What is wrong with the record, its headers and block, and where the next one begins."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/", at) or end < 0:
        return "not a WARC record", {}, b"", at
    lines = data[at:end].decode(errors="replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "a WARC record has no length", headers, b"", at
    last = end + 4 + int(length)
    if data[last:last + 4] != b"\r\n\r\n":
        return "a WARC record is cut off", headers, b"", at
    return None, headers, data[end + 4:last], last + 4


def _page(name: str | None) -> int | None:
    """The page_id in an identifier of this module's writer; null for any other."""
    number = re.match(r"<?urn:page:(\d+|-\d+)(?::|>|$)", name or "")
    return int(number[1]) if number else None


def _hex_digest(stated: str | None) -> str | None:
    """A stated SHA-1 digest in hex; many writers use base 32. Null for other kinds."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return None
    return value.lower()


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _decoded(page_id: int | None, block: bytes, digest: str | None, place: tuple) -> tuple:
    """A row of FIELDS for a whole response; place: record_id, file and offset."""
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as problem:
        return page_id, "response", None, None, None, None, str(problem), *place
    found = hashlib.sha1(payload).hexdigest()
    error = None if digest in (found, None) else "the payload doesn't have the stated digest"
    return page_id, "response", None, payload, len(payload), found, error, *place


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FIELDS for whole records, and of _PARTS for segments; the other side's columns are null."""
    parts = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _PARTS.split(", ")]
    whole, part = [None] * len(_NAMES), [None] * len(names)
    for batch in batches:
        for file, value in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows: list[tuple] = []
            for offset, headers, block, problem in parse(value.as_py()):
                name, kind = headers.get("warc-record-id"), headers.get("warc-type")
                place, digest = (name, file, offset), _hex_digest(headers.get("warc-payload-digest"))
                number = headers.get("warc-segment-number")
                if problem:
                    rows.append((_page(name), kind, *[None] * 4, problem, *place, *part))
                elif number:
                    total = _number(headers.get("warc-segment-total-length"))
                    origin = headers.get("warc-segment-origin-id", name)
                    if kind in ("response", "continuation"):
                        rows.append((*whole, origin or "", _number(number), total, _page(name), digest, block, file, offset))
                elif kind == "revisit":
                    size = _number(headers.get("x-payload-bytes"))
                    rows.append((_page(name), kind, _page(headers.get("warc-refers-to")), None, size, digest, None, *place, *part))
                elif kind == "response":
                    rows.append((*_decoded(_page(name), block, digest, place), *part))
            columns = zip(*rows, strict=True) if rows else [()] * (len(_NAMES) + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*_TYPES, *parts], strict=True)], [*_NAMES, *(f"part_{n}" for n in names)])


def reassemble(group: pd.DataFrame) -> pd.DataFrame:
    """One row of FIELDS for the segments of a record; `error` says what is wrong with them."""
    group = group.sort_values("part_number")
    first = group.iloc[0]
    page_id = None if pd.isna(first["part_page_id"]) else int(first["part_page_id"])
    place = (first["part_origin"], first["part_file"], int(first["part_offset"]))
    numbers, total = group["part_number"].tolist(), group["part_total"].dropna().tolist()
    block = b"".join(group["part_block"])
    if numbers != list(range(1, len(numbers) + 1)):
        row = (page_id, "response", None, None, None, None, "segments are missing or repeated", *place)
    elif len(total) != 1 or int(total[0]) != len(block):
        row = (page_id, "response", None, None, None, None, "the segments don't have the stated total length", *place)
    else:
        row = _decoded(page_id, block, first["part_digest"], place)
    return pd.DataFrame([row], columns=_NAMES).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "offset": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row of FIELDS for every response and revisit in the WARC files below path, plain or in gzip members.

    payload_bytes and payload_digest are those of the whole payload, for revisits as their record states them.
    error is null, or says why a record couldn't be read or put together; such a record has no payload, or one that
    doesn't have its stated digest. page_id and refers_to are null for records of other writers, which record_id names; file
    and offset (in gzip files of the member) say where a record, or the first of its segments, begins. A digest that isn't
    SHA-1 isn't checked. Records of other types are passed over; no files, or empty ones, give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = ", ".join(f"part_{x}" for x in _PARTS.split(", "))
    # Both sides parse the files; keeping the payloads in between would take as much disk as the archives.
    rows = files.mapInArrow(_unpack, f"{FIELDS}, {parts}")
    whole = rows.where("part_origin is null").select(*_NAMES)
    segments = rows.where("part_origin is not null").select(*[f"part_{x.split()[0]}" for x in _PARTS.split(", ")])
    return whole.unionByName(segments.groupBy("part_origin").applyInPandas(reassemble, FIELDS))
