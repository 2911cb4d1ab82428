"""WARC records in ZIP packages, read back by ranges.

Writing: each task streams its pages into packages of its own, a ZIP holding
one stored member ``archive/data.warc.gz`` (a gzip member per record) and one stored
member ``indexes/index.jsonl`` (offset and length of each record).  Of pages with
equal payloads the one with the smallest id is the response, the others are revisit records
without a payload.  Reading: the end of a package leads to the (ZIP64)
central directory, the directory to the stored members, the index to the records, and
each record is read by its range; nothing is extracted.

Only the digests that several pages share are joined to the pages, so pages
are not shuffled unless those outgrow Spark's broadcast limit.

Defined cases: null html is an empty payload (an empty payload is one like any other);
rows repeating the smallest id of a payload are responses, too; a null id is
larger than any other, and payloads with null ids only are all responses; a null
url has no target header; an empty table gives no packages and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from .common import all_chunks, materialise, partitions_of

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
# fixed values of the ZIP format: signatures and the size that refers to ZIP64
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_DATE = "2024-01-01T00:00:00Z"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path behind a Hadoop-style path."""
    path = re.sub(r"^file:/+", "file:///", path)
    if path.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _header(lines: list[tuple[str, object]], first: str) -> bytes:
    rows = [first, *(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in lines if v is not None)]
    return ("\r\n".join(rows) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One record and its payload digest; ``refers_to`` makes it a revisit."""
    digest = base32_sha1(payload)
    block = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    kind = "response"
    more: list[tuple[str, object]] = []
    if refers_to is not None:
        kind = "revisit"
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    else:
        block += payload
    head = _header([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
                    ("WARC-Target-URI", url), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), *more,
                    ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))], "WARC/1.1")
    return head + block + b"\r\n\r\n", digest


def _fields(raw: bytes) -> tuple[dict[str, str], int]:
    """Header fields and where the block after them starts."""
    end = raw.index(b"\r\n\r\n")
    rows = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows)}, end + 4


def parsed(raw: bytes) -> dict:
    """What a record says of its page; a response's length and digest are taken from its payload."""
    head, at = _fields(raw)
    block = raw[at:at + int(head["content-length"])]
    http, start = _fields(block)
    number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        size, digest, refers = int(http["content-length"]), stated, number(head["warc-refers-to"])
    else:
        size, digest, refers = len(block) - start, base32_sha1(block[start:]), None
        if digest != stated:
            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
    return {"page_id": number(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": head["warc-type"], "refers_to": refers}


class PackageWriter:
    """Streams records into one ZIP; the index is written when it closes."""

    def __init__(self, path: str, level: int):
        fs, inner = file_system(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.path, self.level, self.at, self.index = path, level, 0, []
        self.sink = fs.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, raw: bytes):
        press = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = press.compress(raw) + press.flush()
        self.data.write(member)
        self.index.append((self.at, len(member)))
        self.at += len(member)

    def close(self):
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            for offset, length in self.index:
                f.write(json.dumps({"offset": offset, "length": length}).encode() + b"\n")
        self.zip.close()
        self.sink.close()


class PackageReader:
    """Random access to the stored members of a ZIP, by its directories only."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()
        self.members = self._directory()

    def _range(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Name -> (where its bytes start, how many) of every member."""
        tail_at = max(0, self.size - 22 - _FULL16)
        tail = self._range(tail_at, self.size - tail_at)
        end = tail.rfind(_END)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        locator = tail_at + end - 20
        if locator >= 0 and self._range(locator, 4) == _LOCATOR64:
            at = struct.unpack_from("<Q", self._range(locator, 20), 8)[0]
            end64 = self._range(at, 56)
            if end64[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory, at, out = self._range(start, length), 0, {}
        for _ in range(count):
            if directory[at:at + 4] != _ENTRY:
                raise ValueError("central directory is damaged")
            method, = struct.unpack_from("<H", directory, at + 10)
            packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, at + 20)
            offset, = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46:at + 46 + name_n].decode("utf-8")
            extra = directory[at + 46 + name_n:at + 46 + name_n + extra_n]
            packed, offset = self._wide(extra, plain, packed, offset)
            if method != 0:
                raise ValueError(f"member {name} is not stored")
            local = self._range(offset, 30)
            if local[:4] != _LOCAL:
                raise ValueError(f"member {name} has no local header")
            out[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
            at += 46 + name_n + extra_n + comment_n
        return out

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, offset: int) -> tuple[int, int]:
        """Sizes that do not fit 32 bits stand in the ZIP64 extra field, in this order."""
        at = 0
        while at + 4 <= len(extra):
            tag, size = struct.unpack_from("<HH", extra, at)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
                if plain == _FULL32:
                    next(values)
                packed = next(values) if packed == _FULL32 else packed
                offset = next(values) if offset == _FULL32 else offset
            at += 4 + size
        return packed, offset

    def records(self, read: int = 1 << 20):
        """(offset, length) of every record, from the index member."""
        start, length = self.members[INDEX]
        left, at = b"", start
        while at < start + length:
            part = self._range(at, min(read, start + length - at))
            at += len(part)
            *lines, left = (left + part).split(b"\n")
            for line in lines:
                entry = json.loads(line)
                yield entry["offset"], entry["length"]

    def record(self, offset: int, length: int) -> bytes:
        return zlib.decompress(self._range(self.members[DATA][0] + offset, length), 31)

    def close(self):
        self.file.close()


def _write(folder: str, package_bytes: int, level: int):
    def run(batches):
        """Packages of this attempt, under names of its own; only rows that Spark commits name any."""
        writer, done = None, []
        for batch in all_chunks(batches, "html"):
            for page, url, html, least in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "least"))):
                revisit = least is not None and (page is None or page > least)
                raw, _ = record(page, url, (html or "").encode("utf-8", "surrogatepass"), least if revisit else None)
                if writer is None:
                    writer = PackageWriter(f"{folder}/{uuid.uuid4().hex}.zip", level)
                writer.add(raw)
                if writer.at >= package_bytes:
                    writer.close()
                    done.append(writer.path)
                    writer = None
        if writer is not None:
            writer.close()
            done.append(writer.path)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["package"])
    return run


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, package_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Write every page as a WARC record; returns the table of packages.

    Payloads below ``least_bytes`` bytes are never revisits.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("digest", F.unhex(F.sha1(body.cast("binary"))))
    shared = materialise(
        rows.where(F.octet_length(body) >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("pages")).where("pages > 1").select("digest", "least"),
        "shared-payloads")
    marked = rows.join(shared, "digest", "left").select("page_id", "url", "html", "least")
    return materialise(marked.mapInArrow(_write(folder, package_bytes, level), "package string"), "packages")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])


def _list_records(batches):
    """Ranges of each package, in blocks of neighbouring records."""
    for batch in batches:
        for package in batch.column("package").to_pylist():
            reader = PackageReader(package)
            block: list[tuple[int, int]] = []
            for place in reader.records():
                block.append(place)
                if len(block) == 1024:
                    yield _block(package, block)
                    block = []
            if block:
                yield _block(package, block)
            reader.close()


def _block(package: str, places: list[tuple[int, int]]) -> pa.RecordBatch:
    offsets, lengths = (list(x) for x in zip(*places))
    return pa.RecordBatch.from_arrays([pa.array([package]), pa.array([offsets], pa.list_(pa.int64())),
                                       pa.array([lengths], pa.list_(pa.int64()))], ["package", "offsets", "lengths"])


def _read_records(batches):
    for batch in batches:
        for package, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("package", "offsets", "lengths"))):
            reader = PackageReader(package)
            rows = [parsed(reader.record(o, n)) for o, n in zip(offsets, lengths)]
            reader.close()
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record of the packages that column ``package`` names; blocks of ranges are dealt out evenly."""
    n = partitions_of(packages)
    ranges = packages.repartition(n).mapInArrow(_list_records, "package string, offsets array<long>, lengths array<long>")
    return ranges.repartition(n).mapInArrow(_read_records, RECORD)


def packages_folder(pages: DataFrame) -> str:
    """A fresh folder for packages under the shared work folder."""
    return work_path(pages.sparkSession, "llm", "warc")
