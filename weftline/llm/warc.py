"""WARC records: segment reassembly and chunked transfer framing.

A record that was too long for one file is a first record with segment number 1
and continuation records that name it in WARC-Segment-Origin-ID; the last one
gives the total length.  Records without a segment number pass without a
shuffle; the others are grouped by origin, put in order of their segment
numbers, checked, joined, and the HTTP body is freed of chunked framing.

Results for odd input (column status): "ok"; "bad_record" (null, empty or without
a WARC head, or a content shorter than it says); "missing_segment" (no first one,
or a gap); "no_total" (no segment gives a total length); "length_mismatch";
"conflicting_segment" (two different contents of one number; equal repeated
segments count once); "no_segment_number" (a continuation, or a segmented record,
whose number can't be read: a row of its own); "bad_framing" (chunk sizes don't
hold).  The body is null unless the status is "ok".  Records of other types than
response and continuation are passed over unless they are segmented.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4096
SEGMENT = 2048
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """The body in chunked transfer framing."""
    parts = []
    for i in range(0, len(body), size):
        piece = body[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes:
    """The body without chunked framing; ValueError if the framing doesn't hold. Extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk without a size line")
        size = data[at:end].split(b";", 1)[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk size that isn't hexadecimal")
        n, at = int(size, 16), end + 2
        if n == 0:
            if data[at : at + 2] != b"\r\n" and b"\r\n\r\n" not in data[at:]:
                raise ValueError("no end of the last chunk")
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk of another length than it says")
        out.append(data[at : at + n])
        at += n + 2


def _records(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                out = []
                for page, url, html in zip(*(c.to_pylist() for c in b.slice(i, 500).columns)):
                    block = _HEAD + chunked((html or "").encode())
                    name = b"<urn:uuid:00000000-0000-4000-8000-%012d>" % page
                    last = max(0, (len(block) - 1) // segment)
                    for k in range(last + 1):
                        piece = block[k * segment : (k + 1) * segment]
                        head = [b"WARC/1.1"]
                        if k == 0:
                            head += [b"WARC-Type: response", b"WARC-Record-ID: " + name, b"WARC-Target-URI: " + (url or "").encode()]
                        else:
                            head += [b"WARC-Type: continuation", b"WARC-Record-ID: <urn:uuid:%08d-0000-4000-8000-%012d>" % (k, page), b"WARC-Segment-Origin-ID: " + name]
                        if last:
                            head.append(b"WARC-Segment-Number: %d" % (k + 1))
                            if k == last:
                                head.append(b"WARC-Segment-Total-Length: %d" % len(block))
                        out.append(b"\r\n".join([*head, b"Content-Length: %d" % len(piece), b"", piece, b"", b""]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_records(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """record (binary): WARC records of pages (page_id, url, html), in segments of at most so many bytes; rows without page_id are left out."""
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_records(segment), "record binary")


def parse(record: bytes | None) -> tuple[dict[str, str], bytes] | None:
    """The named fields (lower case) and the content of one record, plain or gzipped; None if it isn't one."""
    if record and record[:2] == b"\x1f\x8b":
        try:
            record = gzip.decompress(record)
        except (OSError, EOFError):
            return None
    if not record or not record.startswith(b"WARC/"):
        return None
    end = record.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in record[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdecimal():
        return None
    content = record[end + 4 : end + 4 + int(length)]
    return (fields, content) if len(content) == int(length) else None


_PARSED = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("uri", pa.string()), ("content", pa.binary()), ("known", pa.bool_())])
_PARSED_DDL = "origin string, segment int, total long, uri string, content binary, known boolean"


#: Stands for the number of a segment that gives none that can be read.
UNREADABLE = -1


def _number(text: str | None, bits: int = 63) -> int | None:
    number = int(text) if text and text.isdecimal() and len(text) < 20 else 1 << bits
    return number if number < 1 << bits else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            rows = []
            for raw in b.column(0).slice(i, 1000).to_pylist():
                found = parse(raw)
                if found is None:
                    rows.append((None, None, None, None, None, False))
                    continue
                fields, content = found
                kind = fields.get("warc-type")
                if kind == "response" or kind == "continuation" or "warc-segment-number" in fields:
                    origin = fields.get("warc-segment-origin-id") if kind == "continuation" else fields.get("warc-record-id")
                    segment = _number(fields.get("warc-segment-number"), 31)
                    if segment is None and (kind == "continuation" or "warc-segment-number" in fields):
                        segment = UNREADABLE
                    rows.append((origin, segment, _number(fields.get("warc-segment-total-length")), fields.get("warc-target-uri"), content, True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_PARSED), _PARSED)], schema=_PARSED)


def body(block: bytes) -> bytes:
    """The body of an HTTP response, without chunked framing."""
    head, found, rest = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return block
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and value.strip().lower().endswith(b"chunked"):
            return dechunked(rest)
    return rest


def join(segments: list[tuple[int | None, int | None, bytes]]) -> tuple[str, bytes]:
    """(status, whole block) of (number, total, content) segments in any order; a number of None: not segmented."""
    if any(number == UNREADABLE for number, _, _ in segments):
        return "no_segment_number", b""
    by: dict[int, bytes] = {}
    totals = set()
    for number, total, content in segments:
        n = 1 if number is None else number
        if by.setdefault(n, content) != content:
            return "conflicting_segment", b""
        if total is not None:
            totals.add(total)
    if sorted(by) != list(range(1, len(by) + 1)):
        return "missing_segment", b""
    whole = b"".join(by[k] for k in range(1, len(by) + 1))
    if not totals and any(n is not None for n, _, _ in segments):
        return "no_total", b""
    if totals and totals != {len(whole)}:
        return "length_mismatch" if len(totals) > 1 or len(whole) > max(totals) else "missing_segment" if len(whole) < max(totals) else "length_mismatch", b""
    return "ok", whole


_OUT = "record_id string, uri string, n_segments int, total_length long, status string, body binary"
_OUT_PA = pa.schema([("record_id", pa.string()), ("uri", pa.string()), ("n_segments", pa.int32()), ("total_length", pa.int64()), ("status", pa.string()), ("body", pa.binary())])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part, rows = b.slice(i, 500), []
            for origin, uri, known, segments in zip(*(c.to_pylist() for c in part.columns)):
                if not known:
                    rows.append((None, None, 0, None, "bad_record", None))
                    continue
                status, whole = join([(s["segment"], s["total"], s["content"]) for s in segments])
                data = None
                if status == "ok":
                    try:
                        data = body(whole)
                    except ValueError:
                        status = "bad_framing"
                rows.append((origin, uri, len({s["segment"] for s in segments}), len(whole) if status in ("ok", "bad_framing") else None, status, data))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT_PA), _OUT_PA)], schema=_OUT_PA)


def reassemble(records: DataFrame) -> DataFrame:
    """record_id, uri, n_segments, total_length, status, body of every whole record; records: a binary column record."""
    parsed = records.select(F.col("record").cast("binary")).mapInArrow(_parse, _PARSED_DDL)
    one = F.struct("segment", "total", "content")
    whole = parsed.where(f"segment is null or segment = {UNREADABLE} or origin is null").select("origin", "uri", "known", F.array(one).alias("segments"))
    cut = parsed.where(f"segment <> {UNREADABLE} and origin is not null").groupBy("origin").agg(F.max("uri").alias("uri"), F.min("known").alias("known"), F.collect_list(one).alias("segments"))
    return whole.unionByName(cut).mapInArrow(_assemble, _OUT)


#: Bytes read from a file at a time.
READ = 1 << 20


def _plain(file: BinaryIO) -> Iterator[bytes]:
    """The bytes of a file, plain or of any number of gzip members, some at a time; a member that breaks off ends them."""
    data = file.read(READ)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = file.read(READ)
        return
    member = zlib.decompressobj(31)
    while data:
        try:
            out = member.decompress(data, READ)
        except zlib.error:
            return
        if out:
            yield out
        if member.eof:
            data, member = member.unused_data.lstrip(b"\0") or file.read(READ), zlib.decompressobj(31)
        else:
            data = member.unconsumed_tail or file.read(READ)


def split(file: BinaryIO) -> Iterator[bytes]:
    """The records of a file one after the other, by their Content-Length; what holds no head is a record of its own."""
    data, parts = b"", _plain(file)

    def fill(n: int) -> None:
        nonlocal data
        more, size = [data], len(data)
        while size < n and (x := next(parts, b"")):
            more.append(x)
            size += len(x)
        data = b"".join(more)

    while True:
        end = data.find(b"\r\n\r\n")
        while end < 0:
            before = len(data)
            fill(before + READ)
            if len(data) == before:
                break
            end = data.find(b"\r\n\r\n", max(0, before - 3))
        if end < 0:
            if data:
                yield data
            return
        size = next((int(v) for n, _, v in (x.partition(b":") for x in data[:end].split(b"\r\n")) if n.strip().lower() == b"content-length" and v.strip().isdigit()), 0)
        stop = end + 4 + size + 4
        fill(stop)
        yield data[:stop]
        data = data[stop:]


def _open(path: str) -> BinaryIO:
    """A file of any file system that pyarrow knows, for reading from its beginning on."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_stream(inner, compression=None, buffer_size=READ)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            out, size = [], 0
            with _open(path) as file:
                for record in split(file):
                    out.append(record)
                    size += len(record)
                    if size >= 8 * READ:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record (binary) of WARC files, plain or gzipped, each file by one task, which holds a record at a time whatever the file's size."""
    names = spark.read.format("binaryFile").load(path).select("path")
    return names.repartition(max(1, names.count()), "path").mapInArrow(_files, "record binary")
