"""WARC records in ZIP packages: a writer, and a reader that reads records by their byte ranges.

A package is a ZIP file whose members are stored, not compressed: `archive/data.warc.gz` with the records one after
the other, each zipped by itself, and `indexes/index.cdx` with a line (offset, length, record id) for each. Nothing is extracted: the
reader finds the end record (and the ZIP64 end record where one is needed), reads the central directory, finds
where the stored members lie, reads the index and then ranges of the records it names. A package of plain
records without an index is read record by record from the member's start.

Records with equal payloads of `min_bytes` or more are stored once: that with the largest page_id is a response,
the others are revisits without payload that refer to it. Their HTTP headers keep the payload's length, their WARC
headers its digest.

Tasks write packages of about `roll_bytes` into the shared folder under fresh names; only names that a finished
task has returned are read, so what a lost or repeated task leaves behind does no harm. A package is one unit of
reading and holds a bounded number of bytes (one record if that is larger). Equal payloads are counted by digest
with map-side combining and met by a join, which Spark splits where it is skewed.

Null html is an empty payload; a null url gives a record without target; a null page_id stays null. Of rows that
repeat page_id and html one is the response. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Bloom, bloom_of, map_batches, settle, shared_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ROLL_BYTES = 16 << 20
READ_BYTES = 4 << 20
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system for a path that Spark gave, which may be file:/x with one slash."""
    if path.startswith("file:") or path.startswith("/"):
        return pafs.LocalFileSystem(), unquote(re.sub(r"^file:/*", "/", path))
    return pafs.FileSystem.from_uri(path)


# ------------------------------------------------------------------ records


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _unzipped(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw.startswith(b"\x1f\x8b") else raw


def parse_record(raw: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record at this place")
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = _headers(head)
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    kind = named["warc-type"]
    if kind == "response" and digest_of(payload) != digest:
        raise ValueError(f"payload of {named['warc-record-id']} differs from its digest")
    return {
        "page_id": _page(named["warc-record-id"]),
        "url": named.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": int(_headers(http)["content-length"]),
        "payload_digest": digest,
        "refers_to": _page(named.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


# ------------------------------------------------------------------ ZIP


def zip_bytes(members: list[tuple[str, bytes]], zip64_from: int = _MAX32) -> bytes:
    """A ZIP of stored members; sizes and offsets of `zip64_from` or more are written as ZIP64."""
    body, directory = bytearray(), bytearray()
    for name, data in members:
        label, crc, at = name.encode(), zlib.crc32(data), len(body)
        big = len(data) >= zip64_from or at >= zip64_from
        sizes = (_MAX32, _MAX32) if big else (len(data), len(data))
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        version = 45 if big else 20
        body += struct.pack("<IHHHHHIIIHH", 0x04034B50, version, 0, 0, 0, 33, crc, *sizes, len(label), len(extra)) + label + extra
        body += data
        central = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        directory += struct.pack(
            "<IHHHHHHIIIHHHHHII", 0x02014B50, version, version, 0, 0, 0, 33, crc, *sizes, len(label), len(central), 0, 0, 0, 0, _MAX32 if big else at
        )
        directory += label + central
    start, size, n = len(body), len(directory), len(members)
    tail = b""
    if start >= zip64_from or n >= _MAX16:
        tail = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start)
        tail += struct.pack("<IIQI", 0x07064B50, 0, start + size, 1)
        n, size, start = _MAX16, _MAX32, _MAX32
    return bytes(body + directory) + tail + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0)


class Package:
    """The stored members of a ZIP that is open for reading at any place."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        self.size = source.size()
        self.members = {name: (method, size, at) for name, method, size, at in self._directory()}

    def read(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at)

    def _directory(self) -> Iterator[tuple[str, int, int, int]]:
        first = max(0, self.size - 22 - _MAX16 - 20)  # the longest comment, and the ZIP64 locator before it
        tail = self.read(first, self.size - first)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        *_, size, start, _ = struct.unpack("<IHHHHIIH", tail[at : at + 22])
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            (end,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            size, start = struct.unpack("<QQ", self.read(end, 56)[40:56])
        raw, i = self.read(start, size), 0
        while i < len(raw):
            if raw[i : i + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack("<H", raw[i + 10 : i + 12])
            packed, full, n_name, n_extra, n_note = struct.unpack("<IIHHH", raw[i + 20 : i + 34])
            offset, = struct.unpack("<I", raw[i + 42 : i + 46])
            name = raw[i + 46 : i + 46 + n_name].decode()
            extra = raw[i + 46 + n_name : i + 46 + n_name + n_extra]
            full, packed, offset = self._wide(extra, full, packed, offset)
            yield name, method, full, offset
            i += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values that the ZIP64 field holds instead, in its order."""
        out, i = list(values), 0
        while i + 4 <= len(extra):
            tag, size = struct.unpack("<HH", extra[i : i + 4])
            if tag == 1:
                at = i + 4
                for k, v in enumerate(values):
                    if v == _MAX32:
                        (out[k],) = struct.unpack("<Q", extra[at : at + 8])
                        at += 8
            i += 4 + size
        return out

    def start_of(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many they are."""
        method, size, at = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        n_name, n_extra = struct.unpack("<HH", self.read(at + 26, 4))
        return at + 30 + n_name + n_extra, size

    def records(self) -> Iterator[bytes]:
        for name in self.members:
            if name.endswith((".warc", ".warc.gz")) and INDEX in self.members:
                yield from map(_unzipped, self._indexed(name))
            elif name.endswith(".warc"):
                yield from self._scanned(name)
            elif name.endswith(".warc.gz"):
                raise ValueError(f"{name} holds zipped records, which only an index can tell apart")

    def _indexed(self, name: str) -> Iterator[bytes]:
        start, size = self.start_of(INDEX)
        ranges = [tuple(map(int, x.split(" ")[:2])) for x in self.read(start, size).decode().splitlines()]
        start, _ = self.start_of(name)
        i = 0
        while i < len(ranges):  # neighbouring records are fetched together
            j, at = i, ranges[i][0]
            while j + 1 < len(ranges) and ranges[j + 1][0] == sum(ranges[j]) and sum(ranges[j + 1]) - at <= READ_BYTES:
                j += 1
            raw = self.read(start + at, sum(ranges[j]) - at)
            yield from (raw[a - at : a - at + n] for a, n in ranges[i : j + 1])
            i = j + 1

    def _scanned(self, name: str) -> Iterator[bytes]:
        start, size = self.start_of(name)
        at = 0
        while at < size:
            head, n = b"", 4096
            while b"\r\n\r\n" not in head:
                if len(head) == size - at:
                    raise ValueError("record without end of header")
                head, n = self.read(start + at, min(n, size - at)), 2 * n
            head = head.partition(b"\r\n\r\n")[0]
            length = len(head) + 4 + int(_headers(head)["content-length"]) + 4
            yield self.read(start + at, length)
            at += length


# ------------------------------------------------------------------ Spark


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def _key(sha1: bytes) -> int:
    return int.from_bytes(sha1[:8], "big", signed=True)


def _repeating(pages: DataFrame, bloom: Bloom, wanted: bool) -> DataFrame:
    """Rows (page_id, url, payload, sha1) whose payload may repeat, or the others."""

    def run(batch):
        sha1 = [hashlib.sha1(x).digest() for x in batch.column(2).to_pylist()]
        hits = bloom.hits(np.array([_key(x) for x in sha1], np.int64).view(np.uint64))
        whole = pa.record_batch([*batch.columns, pa.array(sha1, pa.binary())], ["page_id", "url", "payload", "sha1"])
        yield whole.filter(pa.array(hits == wanted))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    return map_batches(rows, run, "page_id long, url string, payload binary, sha1 binary")


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to) of every row.

    Digests are counted without payloads. Rows whose digest occurs once, as a Bloom filter of bounded size tells, go
    straight on; only the others are settled and meet the rest of their group.
    """
    payload = _payload()
    digests = pages.where(F.length(payload) >= min_bytes).select(F.sha1(payload).alias("sha1"))
    twice = digests.groupBy("sha1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.conv(F.substring("sha1", 1, 16), 16, -10).cast("long")
    bloom = bloom_of(settle(twice.select(key.alias("key")), "warc-repeats"), "key")
    alone = _repeating(pages, bloom, False).select(
        "page_id", "url", "payload", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    )
    rows = settle(_repeating(pages, bloom, True).withColumn("row", F.monotonically_increasing_id()), "warc-pages")
    large = F.length("payload") >= min_bytes
    chosen = rows.where(large).groupBy("sha1").agg(F.max(F.struct("page_id", "row")).alias("of"))
    again = large & F.col("of").isNotNull() & (F.col("row") != F.col("of.row"))
    met = rows.join(chosen, "sha1", "left").select(
        "page_id",
        "url",
        "payload",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("of.page_id")).alias("refers_to"),
    )
    return alone.unionByName(met)


def write_packages(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, zip64_from: int = _MAX32) -> DataFrame:
    """Write every row of classified() into packages below `folder`; (path, records, bytes) of the packages."""

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        data, index, done = bytearray(), [], []

        def flush():
            name = f"{base}/part-{uuid.uuid4().hex}.zip"
            raw = zip_bytes([(DATA, bytes(data)), (INDEX, "".join(index).encode())], zip64_from)
            with fs.open_output_stream(name) as out:
                out.write(raw)
            done.append((name.removeprefix(base), len(index), len(raw)))
            data.clear()
            index.clear()

        for batch in batches:
            for page_id, url, payload, kind, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                raw = gzip.compress(record(kind, page_id, url, payload, digest_of(payload), refers_to), 6, mtime=0)
                index.append(f"{len(data)} {len(raw)} {'' if page_id is None else page_id}\n")
                data.extend(raw)
                if len(data) >= roll_bytes:
                    flush()
        if index:
            flush()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.record_batch(
            [pa.array([folder.rstrip("/") + x for x in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["path", "records", "bytes"],
        )

    columns = records.select("page_id", "url", "payload", "record_type", "refers_to")
    return columns.mapInArrow(run, "path string, records long, bytes long")


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages at `path`: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    fields = [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        *([("payload", pa.binary())] if payloads else []),
    ]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as source:
                    rows, held = [], 0
                    for raw in Package(source).records():
                        rows.append(parse_record(raw))
                        held += len(raw) if payloads else 400
                        if held >= READ_BYTES:
                            yield _rows(rows, fields)
                            rows, held = [], 0
                    yield _rows(rows, fields)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return packages.select("path").mapInArrow(run, schema + (", payload binary" if payloads else ""))


def _rows(rows: list[dict], fields: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in fields], [k for k, _ in fields])


def through_packages(pages: DataFrame, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write all pages into packages in the shared folder and read them back."""
    folder = shared_path(pages.sparkSession, "warc-zip")
    packages = settle(write_packages(classified(pages, min_bytes), folder), "warc-packages")
    # A package is a row; each of them is worth a task.
    n = max(1, min(packages.count(), 4096))
    return read_packages(packages.repartition(n), payloads)
