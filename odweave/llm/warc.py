"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP of two stored members: archive/data.warc.gz (each record a gzip member of its own) and indexes/index.cdxj
(a line per record: key, offset and length in the archive, as JSON). The reader parses the end record, the ZIP64 records where
they are needed, and the central directory, finds where a stored member's bytes lie, and reads records by their range.
"""

from __future__ import annotations

import base64
import json
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1
from struct import unpack_from
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.files import new_file, store
from odweave.session import materialize

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed after so many records or so many archived bytes; its index is held in memory until then.
PACKAGE_RECORDS, PACKAGE_BYTES = 50_000, 1 << 30
# Fixed values of the ZIP format: record signatures and sizes, and the mark for "see the ZIP64 field".
_END, _END64_AT, _END64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """Where a stored member's bytes lie in its package."""

    name: str
    offset: int
    size: int


class Package:
    """A ZIP package open for range reads."""

    def __init__(self, file):
        self.file = file
        self.members = {m.name: m for m in self._directory()}

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the package ends too early")
        return data

    def _directory(self) -> list[Member]:
        size = self.file.size()
        tail_at = max(0, size - 22 - _FULL16)  # the end record is followed by a comment of 64 KB at most
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(_END)
        if end < 0:
            raise ValueError("no end record: this is no ZIP package")
        entries, length, start = unpack_from("<HII", tail, end + 10)
        if _FULL16 == entries or _FULL32 in (length, start):
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != _END64_AT:
                raise ValueError("no ZIP64 locator")
            record = self.read(unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != _END64:
                raise ValueError("no ZIP64 end record")
            entries, length, start = unpack_from("<QQQ", record, 32)
        central, at, found = self.read(start, length), 0, []
        for _ in range(entries):
            if central[at : at + 4] != _CENTRAL:
                raise ValueError("the central directory is broken")
            method, packed, whole = unpack_from("<H8xII", central, at + 10)
            n_name, n_extra, n_comment = unpack_from("<HHH", central, at + 28)
            offset = unpack_from("<I", central, at + 42)[0]
            name = central[at + 46 : at + 46 + n_name].decode()
            extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
            whole, packed, offset = _wide(extra, whole, packed, offset)
            at += 46 + n_name + n_extra + n_comment
            if method == zipfile.ZIP_STORED:
                found.append(Member(name, self._data_at(offset), packed))
        return found

    def _data_at(self, offset: int) -> int:
        """A member's bytes follow its local header, whose name and extra field have lengths of their own."""
        header = self.read(offset, 30)
        if header[:4] != _LOCAL:
            raise ValueError("no local header where the directory says")
        return offset + 30 + sum(unpack_from("<HH", header, 26))

    def index(self) -> list[dict]:
        m = self.members[INDEX]
        return [json.loads(line) for line in self.read(m.offset, m.size).splitlines()]

    def record(self, entry: dict) -> tuple[dict[str, str], bytes]:
        """Headers and content block of the record that an index entry names."""
        m = self.members[ARCHIVE]
        if entry["offset"] + entry["length"] > m.size:
            raise ValueError("the index points beyond the archive")
        data = zlib.decompress(self.read(m.offset + entry["offset"], entry["length"]), wbits=31)
        head, _, block = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        return headers, block[: int(headers["Content-Length"])]


def _wide(extra: bytes, *values: int) -> list[int]:
    """Size, packed size and offset: those that are full stand in the ZIP64 extra field, in this order."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        tag, n = unpack_from("<HH", extra, at)
        if tag == 1:
            wide = extra[at + 4 : at + 4 + n]
        at += 4 + n
    out, k = [], 0
    for v in values:
        if v == _FULL32:
            v, k = unpack_from("<Q", wide, k)[0], k + 8
        out.append(v)
    return out


def _record(row: dict) -> bytes:
    """A gzipped record. What a revisit leaves out, its headers still say: digest and length of the full payload."""
    payload = (row["payload"] or "").encode()
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    revisit = row["first"] is not None
    block = b"" if revisit else payload
    uid = uuid5(NAMESPACE_URL, f"page:{row['page_id']}:{row['row']}")
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uid}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if row["url"]:
        headers.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["page_id"] is not None:
        headers.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {row['first']}"]
    data = "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write_package(uri: str, rows: Iterator[dict], index: list[bytes]) -> bool:
    """Writes one package; false when the rows have ended. ``index`` gets the index lines."""
    fs, path = store(uri)
    more, place = True, 0
    with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open(ARCHIVE, "w", force_zip64=True) as archive:
            while len(index) < PACKAGE_RECORDS and place < PACKAGE_BYTES:
                row = next(rows, None)
                if row is None:
                    more = False
                    break
                data = _record(row)
                archive.write(data)
                index.append(json.dumps({"page": row["page_id"], "offset": place, "length": len(data)}).encode())
                place += len(data)
        package.writestr(INDEX, b"\n".join(index))
    return more


def write_packages(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) into packages under ``folder``; gives their list (path, records).

    The payload is the html in UTF-8, a missing one empty. Of rows with equal payloads of at least ``least`` bytes the one
    with the smallest page_id becomes a response, the others revisits of it; smaller payloads are all responses. Of several
    rows with that page_id one, the first as stored, is the response; rows without page_id come last (and are responses if no copy has one). Repeated rows are
    records of their own; an empty table gives no packages; other columns are not read.

    The rows are stored once, numbered. The first of each payload is found by partial sums over digests, so no group of
    copies is ever gathered, and reaches its copies by a join that splits large keys.
    """
    content = F.coalesce(pages["html"], F.lit(""))
    stored = materialize(
        pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].alias("url"), content.alias("payload"))
        .select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    )
    order = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("page"), F.col("row").alias("first_row"), F.col("page_id").alias("first"))
    copies = stored.filter(F.col("bytes") >= least).groupBy("sha1").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n"))
    copies = copies.filter("n > 1").select("sha1", "o.first_row", "o.first")
    linked = stored.join(copies, "sha1", "left")
    revisit = (F.col("bytes") >= least) & (F.col("row") != F.col("first_row")) & F.col("first").isNotNull()
    records = linked.select("page_id", "url", "payload", "sha1", "row", F.when(revisit, F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, task, more = (row for batch in batches for row in batch.to_pylist()), TaskContext.get().partitionId(), True
        while more:
            uri, index = new_file(folder, task, ".wacz"), []
            more = _write_package(uri, rows, index)
            if index:
                yield pa.RecordBatch.from_pylist([{"path": uri, "records": len(index)}])

    fs, path = store(folder)
    fs.create_dir(path)
    records.mapInArrow(write, "path string, records bigint").write.parquet(f"{folder}/packages")
    return pages.sparkSession.read.parquet(f"{folder}/packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """Per record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to, checked.

    ``checked``: the payload of a response has the length and the digest that its headers say (null for a revisit).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("checked", pa.bool_()),
        ])
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            fs, place = store(path)
            with fs.open_input_file(place) as f:
                package, out = Package(f), []
                for entry in package.index():
                    out.append(_summary(*package.record(entry)))
                yield pa.RecordBatch.from_pylist(out, schema)

    spread = packages.select("path").repartition(packages.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, checked boolean")


def _summary(headers: dict[str, str], block: bytes) -> dict:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit, size = headers["WARC-Type"] == "revisit", int(headers["X-Payload-Length"])
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
    return {
        "page_id": page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"],
        "refers_to": refers and int(refers),
        "checked": None if revisit else len(block) == size and base64.b32encode(sha1(block).digest()).decode() == digest,
    }
