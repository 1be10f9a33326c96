"""Web archives in ZIP packages: written by tasks, read back by range without extraction.

A package holds a stored member archive/data.warc.gz (one gzip member per WARC record), a stored CDXJ index with the
offset and length of each record, and datapackage.json. The reader finds the central directory (or its ZIP64 form)
from the end of the file, takes offsets of stored members from it, reads the index, deals the record ranges out, and
reads each record by range. Files are reached through Arrow's file systems, by URI, from any task.

A package's name holds its task attempt, and only the packages that committed attempts have listed are read. So neither
a lost executor's half-written package nor that of a repeated or speculative attempt is seen, and nothing is renamed.

Edge cases: a null html is an empty payload; a null page_id is written without a number and read back as null; a null
url is left out, control characters in it are percent-encoded; repeated rows are records of their own (equal rows with
the largest page_id are all responses); further columns are ignored; an empty table writes no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.session import durable, shared_path, small_batches

LEAST_SHARED_BYTES = 1000
PACKAGE_BYTES = 128_000_000
RANGE_BYTES = 4_000_000  # of a package, read by one task
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"  # tables of pages carry no capture time


def with_types(pages: DataFrame, least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of at least `least` bytes all but that with the
    largest page_id refer to it. Payloads stay with their rows. The keys of payloads that occur twice are written before
    they meet the rows, so that adaptive execution broadcasts them if they are few and else splits the rows of a payload
    that very many pages share."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload"))
    key = [F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("check"), F.octet_length("payload").alias("bytes")]
    rows = rows.select("*", *key)
    again = rows.where(F.col("bytes") >= least).groupBy("digest", "check", "bytes").agg(F.max("page_id").alias("keeps"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(durable(again, "payloads"), ["digest", "check", "bytes"], "left")
    refers = F.when(F.col("keeps").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeps")), F.col("keeps"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    number = record_id.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit with the response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None]:
    """A row of RECORD from one uncompressed WARC record. A response's size and digest come from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, page, url = fields["WARC-Type"], _page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI")
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return page, url, size, stated, kind, _page_of(fields["WARC-Refers-To"])
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"record {page}: payload does not have its digest")
    return page, url, len(payload), digest, kind, None


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system and the path there; the names that Hadoop gives to S3 are mapped to Arrow's."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


class _Package:
    """One open ZIP package; add() streams records, close() writes the index and gives the path, records and bytes."""

    def __init__(self, fs: arrow_fs.FileSystem, folder: str, name: str):
        self.path = f"{folder}/{name}-{TaskContext.get().taskAttemptId()}.wacz"
        self.out = fs.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(MEMBER, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        data = gzip.compress(warc_record(page_id, url, payload, digest, refers_to), 1, mtime=0)
        self.member.write(data)
        self.lines.append(f"{(url or '-').translate({i: '%' for i in range(33)})} {DATE} " + json.dumps({"filename": MEMBER, "offset": self.size, "length": len(data), "digest": f"sha1:{digest}"}))
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.lines) + "\n")
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": MEMBER}, {"path": INDEX}]}))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.size


def write_packages(typed: DataFrame, uri: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """(path, records, bytes) of the packages that hold the rows of with_types()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(uri)
        fs.create_dir(folder, recursive=True)
        open_: _Package | None = None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if open_ is None:
                    open_ = _Package(fs, folder, f"pages-{TaskContext.get().partitionId():06d}-{len(done):04d}")
                open_.add(*row)
                if open_.size >= package_bytes:
                    done.append(open_.close())
                    open_ = None
        if open_:
            done.append(open_.close())
        kinds = {"path": pa.string(), "records": pa.int64(), "bytes": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    return typed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def zip_members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Name -> (offset of its data, stored size, method) from the central directory. read(offset, length) gives bytes."""
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack("<HLL", tail[end + 10 : end + 20])
    if (entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and tail[end - 20 : end - 16] == b"PK\x06\x07":
        record = read(struct.unpack("<Q", tail[end - 12 : end - 4])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack("<QQQ", record[32:56])
    directory, at, out = read(offset, length), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[at + 10 : at + 12])[0]
        packed, plain, name_n, extra_n, comment_n = struct.unpack("<LLHHH", directory[at + 20 : at + 34])
        header = struct.unpack("<L", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 64-bit values stand for those that overflow, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        name_here, extra_here = struct.unpack("<HH", read(header + 26, 4))
        out[name] = (header + 30 + name_here + extra_here, packed, method)
        at += 46 + name_n + extra_n + comment_n
    return out


def _reader(fs: arrow_fs.FileSystem, path: str):
    file = fs.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    return read, file.size()


def record_ranges(packages: DataFrame, uri: str) -> DataFrame:
    """(path, offset, length) of every record, from the packages' directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(uri)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                read, size = _reader(fs, path)
                members = zip_members(read, size)
                if any(members[m][2] for m in members if m.startswith(("archive/", "indexes/"))):
                    raise ValueError(f"{path}: archives and indexes must be stored, not compressed")
                begin, length, _ = members[INDEX]
                found = [json.loads(line.split(" ", 2)[2]) for line in read(begin, length).decode().split("\n")[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([members[x["filename"]][0] + x["offset"] for x in found], pa.int64()), pa.array([x["length"] for x in found], pa.int64())], names=["path", "offset", "length"])

    return packages.select("path").mapInArrow(run, "path string, offset long, length long")


def read_records(ranges: DataFrame, uri: str, parts: int) -> DataFrame:
    """RECORD for each range, read in `parts` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(uri)
        last, read = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != last:
                    last, (read, _) = path, _reader(fs, path)
                rows.append(parse_record(gzip.decompress(read(offset, length))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    # neighbouring ranges of a package stay together, packages are spread
    dealt = ranges.repartition(parts, F.col("path"), F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` as packages in the shared folder and read every record back."""
    small_batches(pages.sparkSession)
    uri = shared_path(pages.sparkSession, "warc")
    packages = durable(write_packages(with_types(pages), uri), "packages")
    size = packages.agg(F.sum("bytes")).collect()[0][0] or 0
    return read_records(record_ranges(packages, uri), uri, max(1, -(-size // (2 * RANGE_BYTES))))
