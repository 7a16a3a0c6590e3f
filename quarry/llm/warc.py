"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (each
record its own gzip member), ``indexes/index.cdxj`` (a line with offset and
length for each record) and ``datapackage.json``. The reader parses the end of
the file, the ZIP64 end where there is one, and the central directory, finds the
members' places, reads the index and then only the byte ranges of the records.
Directories are read by one task each; ranges are dealt out to tasks anew, in
runs of about RANGE_BYTES, so one large archive is read by many.

Records with equal payloads of REVISIT_BYTES or more: the one of the smallest
page_id is a response, the others are revisits without a body that name it.
Archives are named by attempt and only those that a finished task reports are
read, so a lost executor leaves at most an unread file.

Defined results: null and empty pages have an empty payload and are responses;
rows that repeat the smallest page_id of a payload are all responses; null
page_ids are written and read as null and never referred to unless no other row
holds the payload. An empty table gives an empty result. Other columns than
page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.exact_dedup import BROADCAST_ROWS
from quarry.llm.scratch import new_path, written

REVISIT_BYTES, RANGE_BYTES = 100, 4 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_TAIL = 66_000  # the longest comment, the end record and the ZIP64 locator
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n%s" % (len(payload), payload))
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        fields[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload bytes, digest, type, refers_to, url) of one gzip member; the body must match its digest."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    number = lambda name: None if (v := fields[name][10:-1]) == "None" else int(v)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), int(fields["X-Payload-Length"]), digest, "revisit", number("WARC-Refers-To"), fields["WARC-Target-URI"]
    body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number("WARC-Record-ID"), len(body), digest, "response", None, fields["WARC-Target-URI"]


def zip_members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Name -> (place of the data, stored size, method) from the central directory; read(offset, n) gives bytes."""
    at = max(0, size - _TAIL)
    tail = read(at, size - at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (place,) = struct.unpack_from("<Q", tail, end - 12)
        big = read(place, 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", big, 32)
    directory, found, at = read(start, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n_bytes = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64 sizes, those that did not fit, in this order
                values = iter(struct.unpack_from(f"<{n_bytes // 8}Q", extra, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + n_bytes :]
        name_n, extra_n = (struct.unpack("<HH", read(local + 26, 4))) if not name.endswith("/") else (0, 0)
        found[name] = (local + 30 + name_n + extra_n, packed, method)
        at += 46 + struct.unpack_from("<H", directory, at + 28)[0] + struct.unpack_from("<H", directory, at + 30)[0] + comment_n
    return found


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns page_id, url, html, digest, refers_to, revisit: one archive of a task's rows."""
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        index, n = io.StringIO(), 0
        with files.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            with z.open(WARC, "w", force_zip64=True) as member:
                at = 0
                for batch in batches:
                    for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                        raw = record(page_id, url or "", (html or "").encode(), digest, refers_to, revisit)
                        member.write(raw)
                        index.write(json.dumps({"page": page_id, "offset": at, "length": len(raw)}) + "\n")
                        at, n = at + len(raw), n + 1
            z.writestr(INDEX, index.getvalue())
            z.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": WARC, "records": n}, {"path": INDEX}]}))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], names=["path", "records"])

    return write


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each archive: runs of consecutive records as (path, offset, lengths)."""
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            files, path = _open(uri)
            with files.open_input_file(path) as f:
                members = zip_members(lambda at, n: f.read_at(n, at), f.size())
                base, _, method = members[WARC]
                at, size, index_method = members[INDEX]
                if method or index_method:
                    raise ValueError(f"{uri}: archive members are not stored")
                first, lengths, rows = None, [], []
                for line in io.BytesIO(f.read_at(size, at)):
                    entry = json.loads(line)
                    if first is not None and (entry["offset"] != first + sum(lengths) or sum(lengths) >= RANGE_BYTES):
                        rows.append((uri, base + first, lengths))
                        first, lengths = None, []
                    first = entry["offset"] if first is None else first
                    lengths.append(entry["length"])
                if lengths:
                    rows.append((uri, base + first, lengths))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["path", "offset", "lengths"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, offset, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            files, path = _open(uri)
            with files.open_input_file(path) as f:
                raw = f.read_at(sum(lengths), offset)
            at, rows = 0, []
            for n in lengths:
                rows.append(parse_record(raw[at : at + n]))
                at += n
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as archives below folder; (path, records) of each, written by finished tasks."""
    slim = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    equal = slim.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first")
    equal = written(equal, "equal")
    joined = slim.join(F.broadcast(equal) if equal.count() <= BROADCAST_ROWS else equal, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = joined.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"), revisit.alias("revisit"))
    return written(rows.mapInArrow(_write(folder), "path string, records long"), "manifest")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives whose paths are in the column path: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spread = max(2, archives.sparkSession.sparkContext.defaultParallelism)
    ranges = archives.select("path").repartition(spread).mapInArrow(_ranges, "path string, offset long, lengths array<long>")
    return ranges.repartition(spread * 4).mapInArrow(_read, _RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to new archives in the shared folder and read them back."""
    archives = write_archives(pages, new_path(spark, "warc"))
    return read_archives(archives).drop("url")
