"""WARC records in ZIP packages: written by tasks, read back by ranges without extraction.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, in which every
record is a gzip member of its own, and ``indexes/index.cdxj``, a line for each record with its place.
The reader finds the central directory from the end of the file (ZIP64 included), takes the members'
places from it, reads the index, deals ranges of records out to tasks, and each task reads its records'
bytes by offset.

Equal payloads of at least ``REVISIT_FROM`` bytes are stored once: the smallest page_id's record is the
response and the others are revisits of it, which carry the payload's size and digest in their headers.

Defined cases: null html is an empty payload; a null url is an empty target; of rows repeated with the
smallest page_id each is a response; among payloads whose page_ids are all null each is a response; an
empty table gives no archives and no records; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import delete, join_hot, partitions, shared_dir, written

REVISIT_FROM = 100
#: a package is closed once its records take this many bytes; a reading task gets so many records at a time
PACKAGE_BYTES = 64 << 20
RANGE_RECORDS = 1000
_ARCHIVE, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


# ---- records -------------------------------------------------------------------------------------


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def record(page_id, url: str, payload: bytes, digest: str, first) -> bytes:
    """A WARC/1.1 record; with ``first`` a revisit of that page: the HTTP head alone, with the full payload's length."""
    kind = "response" if first is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if first is None else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        lines += [f"WARC-Refers-To: {_urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) and the block of one record; ValueError if it isn't one."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("record is cut short")
    return {"headers": headers, "block": rest[:size]}


def http_payload(block: bytes) -> tuple[dict, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


# ---- ZIP -----------------------------------------------------------------------------------------


def directory(read, size: int) -> dict[str, tuple[int, int]]:
    """Stored members' (offset of their bytes, size) by name. read(offset, length) returns bytes; nothing is extracted."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        mark, _, at, _ = struct.unpack("<4sIQI", read(locator, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, count, length, start = struct.unpack("<4sQHHIIQQQQ", read(at, 56))
        if mark != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
    raw, members, at = read(start, length), {}, 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, full = *struct.unpack("<H", raw[at + 10 : at + 12]), *struct.unpack("<II", raw[at + 20 : at + 28])
        n, e, c = struct.unpack("<HHH", raw[at + 28 : at + 34])
        (offset,) = struct.unpack("<I", raw[at + 42 : at + 46])
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + e]
        x = 0
        while x + 4 <= len(extra):  # a ZIP64 extra field has just those of the three that overflowed, in this order
            tag, many = struct.unpack("<HH", extra[x : x + 4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{many // 8}Q", extra[x + 4 : x + 4 + many // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            x += 4 + many
        at += 46 + n + e + c
        if method == 0:
            name_length, extra_length = struct.unpack("<HH", read(offset + 26, 4))  # the local header has an extra field of its own
            members[name] = offset + 30 + name_length + extra_length, packed
    return members


class Package:
    """One package being written to a file system, as a stream; the index follows the archive."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, at = _open(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(_ARCHIVE, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page_id, url: str, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"url": url, "id": page_id, "offset": self.at, "length": len(packed)}, ensure_ascii=False))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(_INDEX, "w", force_zip64=True) as f:
            f.write("".join(x + "\n" for x in self.index).encode("utf-8", "surrogatepass"))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index)


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write records of (page_id, url, payload binary, digest, first long) and return a row (path, records) for each package.

    A task that runs again writes packages of new names; only those of the attempt that counts are listed.
    """

    def run(batches):
        package, done = None, []
        for b in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                package = package or Package(folder)
                package.add(page_id, url or "", record(page_id, url or "", payload, digest, first))
                if package.at >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return written(pages.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "path string, records long"))


def _ranges(batches):
    for b in batches:
        rows = []
        for path in b.column(0).to_pylist():
            fs, at = _open(path)
            with fs.open_input_file(at) as f:
                members = directory(lambda o, n: f.read_at(n, o), f.size())
                base = members[_ARCHIVE][0]
                o, n = members[_INDEX]
                lines = [json.loads(x) for x in f.read_at(n, o).decode("utf-8", "surrogatepass").split("\n") if x]
            for i in range(0, len(lines), RANGE_RECORDS):
                part = lines[i : i + RANGE_RECORDS]
                rows.append((path, [base + x["offset"] for x in part], [x["length"] for x in part]))
        p, o, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(o, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])


def _read(batches):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "verified", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    for b in batches:
        for path, offsets, lengths in zip(*(c.to_pylist() for c in b.columns)):
            fs, at = _open(path)
            rows = []
            with fs.open_input_file(at) as f:
                for o, n in zip(offsets, lengths):
                    r = parse_record(zlib.decompress(f.read_at(n, o), 31))
                    h = r["headers"]
                    http, body = http_payload(r["block"])
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    whole = h["warc-type"] == "response"
                    rows.append((_from_urn(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], None if whole else _from_urn(h["warc-refers-to"]), len(body) if whole else int(http["content-length"]), digest, hashlib.sha256(body).hexdigest() == digest if whole else None, body if whole else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def read_packages(manifest: DataFrame) -> DataFrame:
    """A row for each record of the packages in ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, verified (the digest of a stored payload was checked), payload."""
    many = partitions(manifest.sparkSession)
    ranges = manifest.select("path").repartition(many).mapInArrow(_ranges, "path string, offsets array<long>, lengths array<long>")
    return ranges.repartition(many).mapInArrow(_read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, payload binary")


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and first: the page of which a record is a revisit, else null."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    again = p.where(F.length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = written(again)
    # a page that very many have in common would bring all of them, payloads and all, to one task
    j = join_hot(p, again, "digest", "times", again.agg(F.sum("times")).first()[0] or 0)
    return j.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("least")), F.col("least")).alias("first"))


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages' packages and read them back; the packages go once the records' digests are written."""
    folder = shared_dir(spark)
    records = read_packages(write_packages(with_first(pages), folder))
    out = written(records.drop("payload"))
    delete(spark, folder)
    return out


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return archive_and_read(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")
