"""Operator 4: WARC records in ZIP packages, written and range-read in tasks.

A package is a ZIP whose members are stored, not deflated: an archive of WARC
records (each its own gzip member) and an index with offset and length of every
record.  A reader finds the end record, the ZIP64 records where there are any,
and the central directory, locates the archive's first byte, and reads only the
ranges that the index names, neighbouring ones together.

Packages are written to the folder that all executors share, through the file
system that the folder's URI names.  A task writes files with names of its own,
and only those in the manifest of finished tasks are read, so retries are safe.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder, width, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PACKAGE_BYTES = 16 << 20  # a package is closed when its archive reaches this
READ_BYTES = 4 << 20  # neighbouring records are read together up to this
LISTED_DIGESTS = 100_000  # repeated digests that are broadcast; more are joined
MIN_REVISIT = 100  # payloads below this are never revisits

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# -- records -----------------------------------------------------------------


def record(page: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; ``first`` names the page whose payload a revisit repeats."""
    block = _HTTP if first is not None else _HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([] if first is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, payload) of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# -- packages ----------------------------------------------------------------


def package(archive: bytes, index: list[tuple[int, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, archive), (INDEX, "".join(json.dumps({"offset": o, "length": n}) + "\n" for o, n in index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(data)
    return out.getvalue()


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


def directory(read, size: int) -> list[Member]:
    """The central directory of a ZIP; ``read(at, n)`` gives bytes."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HLL", tail[at + 10: at + 20])
    where = tail_at + at - 20
    locator = read(where, 20) if where >= 0 else b""
    if locator[:4] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", locator[8:16])
        count, length, start = struct.unpack("<QQQ", read(end64, 56)[32:56])
    data, out, at = read(start, length), [], 0
    for _ in range(count):
        sign, method, packed, full, n, extra, comment, header = struct.unpack("<4s6xH8xLLHHH8xL", data[at: at + 46])
        if sign != b"PK\x01\x02":
            raise ValueError("broken central directory")
        name, fields = data[at + 46: at + 46 + n].decode(), data[at + 46 + n: at + 46 + n + extra]
        while len(fields) >= 4:
            kind, m = struct.unpack("<HH", fields[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{m // 8}Q", fields[4: 4 + m // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            fields = fields[4 + m:]
        out.append(Member(name, method, packed, header))
        at += 46 + n + extra + comment
    return out


def first_byte(read, member: Member) -> int:
    """Where a stored member's data begins."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be range-read")
    sign, name, extra = struct.unpack("<4s22xHH", read(member.header_at, 30))
    if sign != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header_at + 30 + name + extra


def records(path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset in the package, length, record) of every indexed record, in file order."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        read = lambda at, n: f.read_at(n, at)
        members = {m.name: m for m in directory(read, f.size())}
        base, index = first_byte(read, members[ARCHIVE]), members[INDEX]
        lines = read(first_byte(read, index), index.size).decode().splitlines()
        wanted = sorted((x["offset"], x["length"]) for x in map(json.loads, lines))
        while wanted:
            n = 1
            while n < len(wanted) and wanted[n][0] == sum(wanted[n - 1]) and sum(wanted[n]) - wanted[0][0] <= READ_BYTES:
                n += 1
            start = wanted[0][0]
            data = read(base + start, sum(wanted[n - 1]) - start)
            for at, length in wanted[:n]:
                yield base + at, length, zlib.decompress(data[at - start: at - start + length], 31)
            wanted = wanted[n:]


# -- Spark -------------------------------------------------------------------


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        archive, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            nonlocal archive, index
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(package(archive.getvalue(), index))
            out = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": [len(index)]})
            archive, index = io.BytesIO(), []
            return out

        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(i) for i in range(5))):
                data = _gzipped(record(page.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), first.as_py()))
                index.append((archive.tell(), len(data)))
                archive.write(data)
                if archive.tell() >= PACKAGE_BYTES:
                    yield close()
        if index:
            yield close()

    return run


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page; returns the manifest (path, n) of the packages.

    Null html and urls count as empty.  Of equal payloads of at least
    ``MIN_REVISIT`` bytes the rows with the smallest id are responses and the
    others revisit it; rows with a null id never are a target, and are responses
    where no row of that payload has an id.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = written(first, "repeated")
    few = first.limit(LISTED_DIGESTS + 1).count() <= LISTED_DIGESTS
    joined = rows.join(F.broadcast(first) if few else first, "digest", "left")  # only many repeated digests move the html
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    return written(joined.select("page", "url", "html", "digest", refers.alias("first")).mapInArrow(_writer(folder), "path string, n bigint"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page_of = lambda x: int(x[len("<urn:page:"): -1]) if x and x != "<urn:page:>" else None
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for offset, length, data in records(path):
                headers, payload = parse_record(data)
                kind = headers["warc-type"]
                digest = hashlib.sha256(payload).hexdigest() if kind == "response" else headers["warc-payload-digest"].removeprefix("sha256:")
                size = len(payload) if kind == "response" else int(headers["warc-payload-length"])
                rows.append((page_of(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, kind, page_of(headers.get("warc-refers-to")), path, offset, length, payload if kind == "response" else None))
                if len(rows) == 256:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


_READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, package string, offset bigint, length bigint, payload binary"
_READ_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_TYPES)], names=[x.split()[0] for x in _READ.split(", ")])


def read_packages(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the packages that ``manifest`` (path) names.

    A response's digest and size are those of the payload that was read; a
    revisit has none of its own and carries its response's.
    """
    spread = manifest.select("path").repartition(width(manifest.sparkSession))
    if payloads:
        return spread.mapInArrow(_reader, _READ)

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _reader(batches):
            yield out.select(out.schema.names[:-1])

    return spread.mapInArrow(slim, _READ.rpartition(", ")[0])


def package_folder(spark: SparkSession) -> str:
    folder = shared_folder(spark, "packages")
    return folder if "://" in folder else ("file://" + folder.removeprefix("file:"))
