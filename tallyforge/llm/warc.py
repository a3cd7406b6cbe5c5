"""Web archives packaged as ZIP files, written and read in parallel.

Writing: each task streams its pages into ZIP files of about ``archive_bytes``
with two stored members, the gzipped records and an index of their places. ZIP64
fields are always written, so size is no limit. Paths are new for each attempt
and listed in a settled table, so a repeated task leaves an unlisted file at
worst and a reader sees each page once.

Reading: the tail of a file gives the central directory (the ZIP64 one where it
is needed), that gives the members' places, the index the records' places, and
each record is read by its range; nothing is extracted.

Records of equal payloads of at least ``min_bytes``: the smallest id is the
response, others revisit it. Defined cases: null html is an empty payload; a
null id is written as such, is larger than any id, and is a response only if all
ids of its payload are null; rows repeating the smallest id are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import HOT_LEAST, col, hot_floor, join_groups, parts_for, short_batches
from tallyforge.session import scratch_path, settle

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the HTTP head only, and its payload's digest and length as fields."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
              f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}")
    if revisit:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes, verify: bool = True) -> dict:
    """The fields of one record and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if verify and not revisit and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda name: None if (x := fields[name].strip("<>").rpartition(":")[2]) == "None" else int(x)
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
            "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number("WARC-Refers-To") if revisit else None, "payload": None if revisit else payload}


class ArchiveWriter:
    """A ZIP file under way: records go to a stored member as they come, the index follows."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index, self.size = io.BytesIO(), 0
        self.records = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.index.write(json.dumps({"id": page_id, "offset": self.size, "length": len(packed)}).encode() + b"\n")
        self.size += len(packed)
        self.records += 1

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            member.write(self.index.getbuffer())
        self.zip.close()


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_bytes: int = 0, least: int = HOT_LEAST) -> DataFrame:
    """page_id, url, html, first_id, revisit. Payloads are told apart by SHA-256, as SHA-1 can be forged.

    The pages of a payload that a sizeable share of all pages has, and ``least`` at least, stay where they are read.
    """
    short_batches(pages.sparkSession)
    html = F.coalesce(col(html_col), F.lit(""))
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"), html.alias("html"),
                        F.when(F.octet_length(html) >= min_bytes, F.sha2(html, 256)).alias("content"))
    shared = (rows.filter("content IS NOT NULL").groupBy("content")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return (join_groups(rows, settle(shared, "shared-payloads"), ["content"], hot_floor(pages.count(), least=least), "left")
            .select("page_id", "url", "html", "first_id",
                    (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write all pages below ``folder``, a shared URI; the settled manifest of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        writer = path = sink = None
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            writer.close()
            sink.close()
            done.append((path, writer.records, writer.size))

        for batch in batches:
            for page_id, url, html, first_id, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    sink = system.open_output_stream(path)
                    writer = ArchiveWriter(sink)
                writer.add(page_id, record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), first_id, revisit))
                if writer.size >= archive_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))],
                                         names=["path", "records", "bytes"])

    planned = with_revisits(pages, id_col, url_col, html_col, min_bytes)
    return settle(planned.mapInArrow(run, MANIFEST), "archive-manifest")


def directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP file by name: (method, packed size, size, place of the local header)."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP directory")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = tail[end - 20:end]
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = file.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        count, length, start = struct.unpack("<QQQ", record[32:56])
    raw, at, found = file.read_at(length, start), 0, {}
    for _ in range(count):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack("<HH", raw[at + 8:at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[at + 20:at + 34])
        local = struct.unpack("<I", raw[at + 42:at + 46])[0]
        name = raw[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: the values that did not fit, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + n:]
        found[name] = method, packed, plain, local
        at += 46 + n_name + n_extra + n_comment
    return found


def member_range(file, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Place and length of a stored member's bytes; the local header's own name and extra field lie before them."""
    method, packed, _, local = entry
    if method != zipfile.ZIP_STORED:
        raise ValueError("only stored members can be read by range")
    head = file.read_at(30, local)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory has one")
    return local + 30 + sum(struct.unpack("<HH", head[26:30])), packed


def archive_records(file, size: int, verify: bool = True) -> Iterator[dict]:
    """All records of an archive in index order, each by its own range."""
    members = directory(file, size)
    start, _ = member_range(file, members[ARCHIVE])
    at, length = member_range(file, members[INDEX])
    for line in file.read_at(length, at).splitlines():
        place = json.loads(line)
        yield parse_record(gzip.decompress(file.read_at(place["length"], start + place["offset"])), verify)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True, batch_rows: int = 256) -> DataFrame:
    """The records of all listed archives, verified against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows: list[dict] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as file:
                    for record in archive_records(file, file.size()):
                        rows.append(record if with_payload else record | {"payload": None})
                        if len(rows) >= batch_rows:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    n = parts_for(manifest.count(), 1)
    return manifest.select("path").repartition(n).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
               archive_bytes: int = 256 << 20, with_payload: bool = False) -> DataFrame:
    """Write pages to archives in the shared folder and read these back."""
    folder = scratch_path(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, id_col, url_col, html_col, min_bytes, archive_bytes), folder, with_payload)
