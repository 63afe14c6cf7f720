"""WARC records in ZIP packages, written and range-read.

A package is a ZIP file of stored (uncompressed) members, as web archive
collections use it: ``archive/data.warc.gz`` (each record a gzip member of its
own), ``indexes/index.cdxj`` (one line a record: key, offset, length) and
``datapackage.json``. The reader takes the end of the file, follows the central
directory (and the ZIP64 one, where sizes or counts need it), finds the stored
members, reads the index, and then reads each record by its byte range; nothing
is extracted.

Packages are written by tasks into the shared folder, under a name that holds
the task's attempt. The list of packages comes from the tasks that succeeded,
so what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, new_path, small_batches, text_of

#: Repeated digests that are broadcast at most (about 120 bytes each).
BROADCAST_ROWS = 500_000
#: Compressed bytes after which a package is closed.
PACKAGE_BYTES = 32 << 20
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_MEMBER, INDEX_MEMBER, ABOUT_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"

# Fixed values of the ZIP format: signatures and field limits.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX16, MAX32, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 0x0001


# Files -----------------------------------------------------------------------


def _filesystem(path: str):
    """A pyarrow file system for a path with a scheme, None for a local one."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return None, urlparse(path).path if scheme else path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class RangeFile:
    """Random access to a file: ``size`` and ``read(start, length)``."""

    def __init__(self, path: str):
        system, name = _filesystem(path)
        self._file = open(name, "rb") if system is None else system.open_input_file(name)  # noqa: SIM115
        self.size = os.fstat(self._file.fileno()).st_size if system is None else self._file.size()

    def read(self, start: int, length: int) -> bytes:
        self._file.seek(start)
        data = self._file.read(length)
        if len(data) != length:
            raise EOFError(f"{length} bytes at {start}: the file ends before")
        return data

    def close(self) -> None:
        self._file.close()


def write_file(path: str, data: bytes) -> None:
    """Write a file so that it appears whole or not at all."""
    system, name = _filesystem(path)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    if system is None:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, name)
    else:
        system.create_dir(os.path.dirname(name), recursive=True)
        with system.open_output_stream(part) as f:
            f.write(data)
        system.move(part, name)


# ZIP -------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` forces the ZIP64 structures."""
    out, directory = io.BytesIO(), io.BytesIO()
    for name, data in members:
        raw, crc, at, size = name.encode(), zlib.crc32(data), out.tell(), len(data)
        large = zip64 or size >= MAX32 or at >= MAX32
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, size, size) if large else b""
        shown = MAX32 if large else size
        out.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if large else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        out.write(data)
        extra = struct.pack("<HHQQQ", ZIP64_FIELD, 24, size, size, at) if large else b""
        directory.write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if large else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, MAX32 if large else at) + raw + extra)
    start, length, count = out.tell(), directory.tell(), len(members)
    out.write(directory.getvalue())
    if zip64 or start >= MAX32 or count >= MAX16:
        end64 = out.tell()
        out.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, length, start))
        out.write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        out.write(struct.pack("<IHHHHIIH", END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
    else:
        out.write(struct.pack("<IHHHHIIH", END, 0, 0, count, count, length, start, 0))
    return out.getvalue()


def zip_members(file) -> dict[str, tuple[int, int, int]]:
    """``name -> (data start, size, method)`` from the central directory.

    ``file`` has ``size`` and ``read``. Only the directory and each member's
    local header are read.
    """
    tail_at = max(0, file.size - 22 - MAX16)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == MAX16 or MAX32 in (length, start):
        where = tail_at + at - 20
        mark, _, end64, _ = struct.unpack("<IIQI", file.read(where, 20)) if where >= 0 else (0, 0, 0, 0)
        if mark == LOCATOR64:
            mark, *_, count, length, start = struct.unpack("<IQHHIIQQQQ", file.read(end64, 56))
            if mark != END64:
                raise ValueError("no ZIP64 end of central directory at its place")
    directory, found, at = file.read(start, length), {}, 0
    for _ in range(count):
        mark, _, _, _, method, _, _, _, packed, size, names, extras, notes, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if mark != CENTRAL:
            raise ValueError("broken central directory")
        name = directory[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra, p = directory[at + 46 + names : at + 46 + names + extras], 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == ZIP64_FIELD:  # holds, in this order, what the entry has no room for
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
                size = next(wide) if size == MAX32 else size
                packed = next(wide) if packed == MAX32 else packed
                offset = next(wide) if offset == MAX32 else offset
            p += 4 + n
        mark, local_names, local_extras = struct.unpack("<I22xHH", file.read(offset, 30))
        if mark != LOCAL:
            raise ValueError(f"{name}: no local header at its place")
        found[name] = (offset + 30 + local_names + local_extras, packed, method)
        at += 46 + names + extras + notes
    return found


# Records ---------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, url: str | None, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", DATE)]
    if url is not None:  # a line break would end the header
        lines.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    lines += [*headers, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def make_record(record_id: str, url: str | None, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """A gzip member with a response, or with a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    about = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        return _record("response", record_id, url, about, http + payload)
    return _record("revisit", record_id, url, [*about, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(member: bytes) -> dict:
    """The fields of a gzip member that holds one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record at this range")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = lambda key: fields[key].removeprefix("<urn:page:").removesuffix(">") if key in fields else None
    found = {"record_id": name("warc-record-id"), "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"), "refers_to": name("warc-refers-to"), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
    if found["record_type"] == "response":
        if base32_sha1(payload) != found["payload_digest"]:
            raise ValueError(f"record {found['record_id']}: the payload does not have its digest")
        return found | {"payload": payload, "payload_bytes": len(payload)}
    return found | {"payload": None, "payload_bytes": int(_headers(http)["content-length"])}


def _name(value) -> str:
    return "" if value is None else str(value)


def write_packages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one record a row into packages below ``path``; ``(package, records)``.

    Payloads are UTF-8, null as empty. Among records with equal payloads of at
    least ``least`` bytes that with the largest key is a response and the
    others are revisits of it (rows that share that key and payload are all
    responses); a null key is smaller than any other. Smaller payloads are
    always responses. An empty table gives no package. Other columns are not
    read. The result is the list of packages, written and reread.
    """
    small_batches(pages.sparkSession)
    body = text_of(payload)
    read = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("sha"))
    # Only digests are grouped (pre-aggregated before the shuffle), and only
    # those of several rows are joined back: as a broadcast while they are few,
    # so that no body is shuffled; else as a skewed join, which is split.
    kept = materialize(read.groupBy("sha").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first", F.lit(True).alias("several")), "repeated")
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    rows = read.join(kept, "sha", "left")
    revisits = F.coalesce("several", F.lit(False)) & (F.octet_length("body") >= least) & ~F.col("key").eqNullSafe(F.col("first"))
    rows = rows.select(F.col("key").cast("string").alias("key"), "url", F.octet_length("body").cast("long").alias("n"), F.unhex("sha").alias("sha"), F.when(revisits, F.col("first").cast("string")).alias("first"), F.when(~revisits, F.col("body").cast("binary")).alias("body"))

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, warc, index = [], io.BytesIO(), []
        owner = uuid.uuid4().hex

        def close():
            name = f"{path}/{owner}-{len(done):05d}.wacz"
            about = json.dumps({"profile": "data-package", "resources": [{"path": WARC_MEMBER, "bytes": warc.tell()}, {"path": INDEX_MEMBER}]})
            write_file(name, zip_stored([(WARC_MEMBER, warc.getvalue()), (INDEX_MEMBER, "".join(index).encode()), (ABOUT_MEMBER, about.encode())]))
            done.append((name, len(index)))
            warc.seek(0)
            warc.truncate()
            index.clear()

        for batch in it:
            for r in batch.to_pylist():
                record = make_record(_name(r["key"]), r["url"], r["body"] or b"", base64.b32encode(r["sha"]).decode(), r["n"], r["first"])
                index.append(f"{_name(r['key'])} {json.dumps({'offset': warc.tell(), 'length': len(record), 'filename': WARC_MEMBER})}\n")
                warc.write(record)
                if warc.tell() >= package_bytes:
                    close()
        if index:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["package", "records"])

    found = rows.mapInArrow(write, "package string, records long")
    list_path = f"{path}.list"
    found.write.parquet(list_path)
    return pages.sparkSession.read.schema("package string, records long").parquet(list_path)


def read_packages(packages: DataFrame, members: str = ".warc.gz") -> DataFrame:
    """One row a record of the packages named in the column ``package``.

    Columns: ``package, record_offset, record_length, record_id, record_type,
    url, refers_to, payload_digest, payload_bytes, payload`` (null for
    revisits). Each record named by an index member is read by its range from a
    stored member ending in ``members``; a compressed one is an error, as its
    records have no ranges. A package without an index gives no row, null
    package names are passed over, and a package listed twice is read twice.
    """
    kinds = "package string, record_offset long, record_length long, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    schema = pa.schema([("package", pa.string()), ("record_offset", pa.int64()), ("record_length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name in batch.column(0).to_pylist():
                file = RangeFile(name)
                try:
                    found = zip_members(file)
                    if bad := [m for m, (_, _, method) in found.items() if m.endswith((members, ".cdxj")) and method]:
                        raise ValueError(f"{name}: {bad[0]} is compressed in the package")
                    rows, held = [], 0
                    for index in sorted(m for m in found if m.endswith(".cdxj")):
                        start, size, _ = found[index]
                        for line in file.read(start, size).decode().splitlines():
                            entry = json.loads(line[line.index("{") :])
                            at = found[entry["filename"]][0] + int(entry["offset"])
                            record = parse_record(file.read(at, int(entry["length"])))
                            rows.append({"package": name, "record_offset": at, "record_length": int(entry["length"])} | record)
                            held += len(record["payload"] or b"") + 200
                            if held >= 4 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                finally:
                    file.close()

    # One task a few packages: each is read by the task that gets its name.
    names = packages.where(F.col("package").isNotNull()).select("package")
    slots = max(1, packages.sparkSession.sparkContext.defaultParallelism) * 4
    return names.repartition(slots, "package").mapInArrow(read, kinds)


def digest_columns(records: DataFrame, key: Column) -> DataFrame:
    return records.select(key.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to").cast("long")).alias("refers_to"))


def op4_warc(spark: SparkSession, root: str) -> DataFrame:
    """Every page written to WARC packages and read back from them."""
    pages = spark.read.parquet(f"{root}/pages.parquet")
    packages = write_packages(pages, new_path(spark, "packages"))
    return digest_columns(read_packages(packages), F.nullif(F.col("record_id"), F.lit("")).cast("long"))


#: Forty hexadecimal digits as base32: four letters for every five digits.
OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS first,
         [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(sha1(body), '.....')] AS five FROM p),
b AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1) for n in five], '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b
"""
