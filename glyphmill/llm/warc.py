"""WARC records in ZIP-packaged web archives: a writer and a range reader.

An archive is a ZIP file of stored members: ``archive/data.warc.gz``, one gzip
member a record, and ``indexes/index.cdx``, one line a record with its offset and
length in the data. The reader parses the end record, the ZIP64 locator and the
central directory, finds where a stored member's bytes lie, reads the index and
then only the byte ranges of the records that are asked for. Nothing is extracted.

Archives are files in a shared folder, written by the tasks as streams and read in
ranges, through whatever file system the folder's scheme names (those of Arrow:
local, HDFS, S3, GCS, Azure). A table lists them: a task that is run again writes
files of other names, and only the files of the attempt that succeeded are listed.

Records with equal payloads are stored once: the one with the smallest id is a
response, the others are revisits that name it and keep the HTTP header, and
with it the length of the payload. Payloads are equal if their SHA-256 and length
are; ids and digests are shuffled for that, payloads only if there are more
revisits than may be broadcast.

Defined cases: a null payload is empty; a null id keeps its row and is the
smallest only if all ids of its payload are null; repeated rows are records of
their own, responses if they have the response's id; very long payloads make an
archive of their own; empty tables give no archive; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Container, Iterator
from dataclasses import dataclass
from typing import BinaryIO, Protocol

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Folder
from .store import Scratch, small_side

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payload bytes after which an archive is closed, bytes of neighbouring records
#: that are read at once, and rows and payload bytes of what the reader yields.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_ROWS, BATCH_BYTES = 32 << 20, 1 << 20, 2_000, 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed signatures and sentinels of the ZIP format.
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x07\x08", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
NONE16, NONE32 = 0xFFFF, 0xFFFFFFFF


class Source(Protocol):
    """Random access to bytes."""

    size: int

    def read(self, offset: int, length: int) -> bytes: ...


class ByteSource:
    def __init__(self, content: bytes):
        self.content, self.size, self.asked = memoryview(content), len(content), 0

    def read(self, offset: int, length: int) -> bytes:
        self.asked += length
        return bytes(self.content[offset : offset + length])


class FileSource:
    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, io.SEEK_END)

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)


class StoredFile:
    """A file of any file system that Arrow knows, by its URI."""

    def __init__(self, uri: str):
        store, path = pa_fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()


class StoredZip:
    """Writes stored members as streams, their sizes in descriptors behind them;
    ZIP64 records where sizes need them or on demand. Members of 4 GiB or more
    need ``zip64``."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.zip64, self.entries = out, zip64, []

    def begin(self, name: str) -> None:
        self.raw, self.at, self.crc, self.n = name.encode(), self.out.tell(), 0, 0
        size = NONE32 if self.zip64 else 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) if self.zip64 else b""
        self.out.write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if self.zip64 else 20, 0x808, 0, 0, 33, 0, size, size, len(self.raw), len(extra)) + self.raw + extra)

    def write(self, content: bytes) -> None:
        self.out.write(content)
        self.crc, self.n = zlib.crc32(content, self.crc), self.n + len(content)

    def end(self) -> None:
        if self.n >= NONE32 and not self.zip64:
            raise ValueError("members of 4 GiB or more need zip64")
        self.out.write(DESCRIPTOR + struct.pack("<IQQ" if self.zip64 else "<III", self.crc, self.n, self.n))
        self.entries.append((self.raw, self.at, self.crc, self.n))

    def add(self, name: str, content: bytes) -> None:
        self.begin(name)
        self.write(content)
        self.end()

    def close(self) -> None:
        start = self.out.tell()
        for raw, at, crc, n in self.entries:
            wide = [self.zip64 or n >= NONE32, self.zip64 or at >= NONE32]
            body = (struct.pack("<QQ", n, n) if wide[0] else b"") + (struct.pack("<Q", at) if wide[1] else b"")
            extra = struct.pack("<HH", 1, len(body)) + body if body else b""
            size, offset = NONE32 if wide[0] else n, NONE32 if wide[1] else at
            version = 45 if extra else 20
            self.out.write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, 0x808, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra)
        end, count = self.out.tell(), len(self.entries)
        if self.zip64 or count >= NONE16 or end >= NONE32:
            self.out.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, end - start, start))
            self.out.write(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
            count, length, start = NONE16, NONE32, NONE32
        else:
            length = end - start
        self.out.write(END + struct.pack("<HHHHIIH", 0, 0, count, count, length, start, 0))


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipReader:
    """The directory of a ZIP archive, and ranges of its stored members."""

    def __init__(self, source: Source):
        self.source = source
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.source.size - 22 - NONE16)
        tail = self.source.read(tail_at, self.source.size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        locator = self.source.read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == LOCATOR64:
            record = self.source.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        raw, p = self.source.read(start, length), 0
        for _ in range(count):
            if raw[p : p + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            method, = struct.unpack_from("<H", raw, p + 10)
            packed, size, n, e, c = struct.unpack_from("<IIHHH", raw, p + 20)
            header, = struct.unpack_from("<I", raw, p + 42)
            name, extra = raw[p + 46 : p + 46 + n], raw[p + 46 + n : p + 46 + n + e]
            while len(extra) >= 4:
                tag, m = struct.unpack_from("<HH", extra)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                    size = wide.pop(0) if size == NONE32 else size
                    packed = wide.pop(0) if packed == NONE32 else packed
                    header = wide.pop(0) if header == NONE32 else header
                extra = extra[4 + m :]
            yield Member(name.decode("utf-8"), method, size, header)
            p += 46 + n + e + c

    def range(self, name: str, offset: int, length: int) -> bytes:
        """Bytes of a stored member; its local header is read once."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members have ranges")
        if name not in self._starts:
            head = self.source.read(m.header, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            self._starts[name] = m.header + 30 + sum(struct.unpack_from("<HH", head, 26))
        return self.source.read(self._starts[name] + offset, min(length, m.size - offset))

    def whole(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name].size)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(value: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{value}')}>"


def write_record(row: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The gzip member of a response, or of a revisit where ``refers_to`` is set."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = json.dumps(url or "")[1:-1]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(row)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row is not None:
        head.append(f"X-Row-ID: {row}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Row-ID: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def read_record(member: bytes) -> Record:
    """The record of one gzip member."""
    raw = gzip.decompress(member)
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _fields(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _fields(http), payload)


class Archive:
    """Writes records into an archive, one after another."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.zip, self.index, self.payload_bytes = StoredZip(out, zip64), [], 0
        self.zip.begin(DATA)

    def add(self, row: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        member, at = write_record(row, url, payload, refers_to), self.zip.n
        self.zip.write(member)
        self.index.append(json.dumps({"row": row, "url": url, "offset": at, "length": len(member)}, ensure_ascii=False))
        self.payload_bytes += len(payload)

    def close(self) -> None:
        self.zip.end()
        self.zip.add(INDEX, "\n".join(self.index).encode("utf-8", "surrogatepass"))
        self.zip.close()


def build(rows: Iterator[tuple[int | None, str | None, bytes, int | None]], zip64: bool = False) -> bytes:
    """A whole archive of (id, url, payload, refers_to) rows, in memory."""
    out = io.BytesIO()
    archive = Archive(out, zip64)
    for row in rows:
        archive.add(*row)
    archive.close()
    return out.getvalue()


def records(source: Source, wanted: Container[int] | None = None) -> Iterator[Record]:
    """The records of an archive by its index, or those whose row is ``wanted``,
    each by its own range; ranges that lie side by side are read together."""
    archive = ZipReader(source)
    entries = (json.loads(line) for line in archive.whole(INDEX).decode("utf-8", "surrogatepass").splitlines())
    held: list[tuple[int, int]] = []

    def read() -> Iterator[Record]:
        start = held[0][0]
        raw = archive.range(DATA, start, held[-1][0] + held[-1][1] - start)
        for offset, length in held:
            yield read_record(raw[offset - start : offset - start + length])
        held.clear()

    for entry in entries:
        if wanted is not None and entry["row"] not in wanted:
            continue
        if held and (sum(held[-1]) != entry["offset"] or sum(held[-1]) - held[0][0] >= RANGE_BYTES):
            yield from read()
        held.append((entry["offset"], entry["length"]))
    if held:
        yield from read()


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is the id of the response of an
    equal payload of at least ``least_bytes``, null for responses."""
    scratch = Scratch(pages.sparkSession, "revisits")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha2("payload", 256))
    marks = scratch.save(rows.select("id", key.alias("key"), F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes), "marks")
    firsts = scratch.save(marks.groupBy("key", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies"), "firsts")
    again = marks.join(small_side(firsts, 48), ["key", "n"]).where(~F.col("id").eqNullSafe(F.col("first")))
    known = scratch.save(again.select(F.col("id").alias("again_id"), F.col("key").alias("again_key"), "first").distinct(), "again")
    same = F.col("id").eqNullSafe(F.col("again_id")) & (key == F.col("again_key"))
    return rows.join(small_side(known, 48), same, "left").select("id", "url", "payload", F.col("first").alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0, *, archive_bytes: int = ARCHIVE_BYTES, zip64: bool | None = None
) -> None:
    """Writes archives of the pages into ``path``/_archives, and at ``path`` the
    table (archive, bytes, records) that lists them."""
    folder = Folder(pages.sparkSession, f"{path}/_archives").qualified()
    wide = archive_bytes > 1 << 31 if zip64 is None else zip64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, archive = "", None, None
        made = []

        def close() -> None:
            archive.close()
            made.append((f"{folder}/{name}", out.tell(), len(archive.index)))
            out.close()

        for batch in batches:
            for i in range(batch.num_rows):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{root}/{name}")
                    archive = Archive(out, wide)
                archive.add(*(column[i].as_py() for column in batch.columns))
                if archive.payload_bytes >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "records"])

    rows = revisits(pages, id_col, payload_col, url_col, least_bytes)
    rows.mapInArrow(run, "archive string, bytes long, records long").write.parquet(path)


def read_archives(archives: DataFrame, payloads: bool = True, wanted: Container[int] | None = None) -> DataFrame:
    """One row per record of a table of archives: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and, with ``payloads``, payload (null
    for revisits). Of other rows than the ``wanted`` ones no byte is read."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 7 if payloads else 6]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)]

    def row_of(r: Record) -> tuple:
        h, number = r.headers, lambda k: int(r.headers[k]) if k in r.headers else None
        held, told = r.kind == "response", h["warc-payload-digest"].partition(":")[2]
        if held and digest(r.payload) != told:
            raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
        size = len(r.payload) if held else int(r.http["content-length"])
        return number("x-row-id"), json.loads(f'"{h["warc-target-uri"]}"'), size, told, r.kind, number("x-refers-to-row-id"), r.payload if held else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                source, rows, size = StoredFile(uri), [], 0
                for r in records(source, wanted):
                    rows.append(row_of(r))
                    size += len(r.payload) if payloads else 0
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                source.close()
                yield batch_of(rows)

    # the table is small, its archives aren't: every one is read by a task of its own
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, ", ".join(f"{n} {'long' if pa.types.is_int64(t) else 'string' if pa.types.is_string(t) else 'binary'}" for n, t in zip(names, kinds)))


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Writes the pages into archives in the shared folder and reads them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = f"{scratch.root}/archives"
    write_archives(pages, path, id_col, payload_col, url_col)
    return read_archives(pages.sparkSession.read.parquet(path), payloads=False)
