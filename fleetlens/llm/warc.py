"""WARC archives: writing pages with revisits, and a reader that salvages damaged files.

Archives are files in a shared folder, one gzip member per record, rolled at a
bounded size; only paths travel between tasks. The reader holds one record at a
time. When a check fails (member CRC, version line, length, digest) it searches
for the next member or version line whose record passes, goes on there and logs
the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize, scratch_path

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
ROLL_BYTES = 16 << 20
CHUNK = 1 << 16
#: Tasks that read archives; beyond that many a task reads several.
MOST_TASKS = 20_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
GZIP_MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "archive string, records bigint, bytes bigint"
READ = "archive string, offset bigint, length bigint, headers map<string,string>, payload binary, gap string"


class DamageError(Exception):
    """What stands at a position is not a whole record."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes
    length: int

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def described(self) -> list[tuple[str, str]]:
        """Headers, then those of the HTTP head as ``http-...`` and the payload digest in hexadecimal."""
        http = {}
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            http["http-" + name.strip().lower()] = value.strip()
        digest = self.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        return list((self.headers | http | {"payload-sha1": base64.b32decode(digest).hex()}).items())


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_bytes(kind: str, page: str, url: str, digest: str, payload_bytes: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record. A revisit has the response's head, with the full length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head + payload
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest": base32_sha1(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        lines |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    text = "".join(f"{k}: {v}\r\n" for k, v in lines.items())
    return VERSION + b"\r\n" + text.encode() + b"\r\n" + block + b"\r\n\r\n"


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, record type and, for revisits, the response's page.

    Payloads are equal if their SHA-1 and length are. Of equal ones of at least
    ``REVISIT_BYTES`` the largest page_id is the response (each of them if it is
    repeated; every one if all ids are null); smaller payloads are all responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("payload_bytes")
    )
    shared = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.join(shared, ["digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        "digest",
        "payload_bytes",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write planned records to archives in ``folder``; returns the manifest (archive, records, bytes).

    Names are new for each task attempt and only finished attempts are listed, so
    a task that runs again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out = name = None
        count = 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(name, compression=None)
                page = "null" if r["page_id"] is None else str(r["page_id"])
                data = record_bytes(r["kind"], page, r["url"], r["digest"], r["payload_bytes"], r["payload"], r["refers_to"])
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(data) + packer.flush())
                count += 1
                if out.tell() >= roll_bytes:
                    done.append((name, count, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, count, out.tell()))
            out.close()
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["archive", "records", "bytes"])

    columns = ["page_id", "url", "digest", "payload_bytes", "payload", "kind", "refers_to"]
    return materialize(records.select(columns).mapInArrow(run, MANIFEST), "manifest")


def parse_record(data: bytes) -> Record:
    """The record at the start of ``data``, with its length and block digest checked."""
    if not VERSION_LINE.match(data):
        raise DamageError("no version line")
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise DamageError("headers do not end")
    headers: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise DamageError("a header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise DamageError("no content length")
    block, tail = rest[: int(size)], rest[int(size) : int(size) + 4]
    if len(block) < int(size) or tail != b"\r\n\r\n":
        raise DamageError("the block does not end where it should")
    if (digest := headers.get("warc-block-digest")) and digest != base32_sha1(block):
        raise DamageError("the block's digest differs")
    return Record(headers, block, len(head) + 4 + int(size) + 4)


class SalvageReader:
    """Records and gaps of one archive, plain or with a gzip member per record, in file order."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def _member(self, at: int) -> Record:
        unpacker, parts, pos = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof:
                if not (chunk := self._at(pos, CHUNK)):
                    raise DamageError("the member is cut off")
                parts.append(unpacker.decompress(chunk))
                pos += len(chunk)
        except zlib.error as e:
            raise DamageError(f"the member is damaged: {str(e).rpartition(': ')[2]}") from None
        record = parse_record(b"".join(parts))
        return record._replace(length=pos - len(unpacker.unused_data) - at)

    def _plain(self, at: int) -> Record:
        """Read to the end of the headers, then as much as they announce."""
        head, n = b"", CHUNK
        while b"\r\n\r\n" not in head and len(head) < self.size - at:
            head = self._at(at, n)
            n *= 2
        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})\s*\r\n", head.partition(b"\r\n\r\n")[0] + b"\r\n")
        want = head.find(b"\r\n\r\n") + 4 + (int(size[1]) if size else 0) + 4
        return parse_record(self._at(at, max(want, min(len(head), CHUNK))) if want > len(head) else head)

    def record_at(self, at: int) -> Record:
        start = self._at(at, 10)
        if start.startswith(GZIP_MAGIC):
            return self._member(at)
        if VERSION_LINE.match(start):
            return self._plain(at)
        raise DamageError("neither a member nor a version line")

    def _next(self, at: int) -> int:
        """Where the next sound record may begin: a member that unpacks to a version line, or such a line."""
        overlap = 16
        while at < self.size:
            chunk = self._at(at, CHUNK)
            for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n", chunk):
                if m[0] != GZIP_MAGIC:
                    return at + m.start()
                try:
                    if VERSION_LINE.match(zlib.decompressobj(31).decompress(self._at(at + m.start(), 4096), 16)):
                        return at + m.start()
                except zlib.error:
                    continue
            at += max(len(chunk) - overlap, 1) if at + len(chunk) < self.size else len(chunk)
        return self.size

    def __iter__(self) -> Iterator[tuple[int, int, Record | None, str | None]]:
        """(offset, length, record, None), or (offset, length, None, reason) for a gap; touching gaps are one."""
        at, gap, reason = 0, -1, ""
        while at < self.size:
            try:
                record = self.record_at(at)
            except DamageError as e:
                if gap < 0:
                    gap, reason = at, str(e)
                at = self._next(at + 1)
                continue
            if gap >= 0:
                yield gap, at - gap, None, reason
                gap = -1
            yield at, record.length, record, None
            at += record.length
        if gap >= 0:
            yield gap, self.size - gap, None, reason


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows of all archives listed: a record (``headers`` with lower-case names, ``payload``) or a gap (its reason)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string())
        names = ["archive", "offset", "length", "headers", "payload", "gap"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for archive in b.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_file(archive) as f:
                    for offset, length, record, reason in SalvageReader(f):
                        row = (record.described(), record.payload) if record else (None, None)
                        rows.append((archive, offset, length, *row, reason))
                        held += len(row[1] or b"")
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    # a task for each archive: the listing itself is too small for Spark to spread
    spread = max(1, min(manifest.count(), MOST_TASKS))
    return manifest.select("archive").repartition(spread).mapInArrow(run, READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, then read these back (see ``read_archives``).

    Null html: an empty payload; null url: empty; a null page_id is written as
    such; repeated rows give a record each; no pages: no archives. Columns
    beyond page_id, url and html are ignored.
    """
    folder = scratch_path(pages.sparkSession, "archives")
    manifest = write_archives(plan_records(pages), folder)
    return read_archives(manifest, folder)


def page_digests(read: DataFrame) -> DataFrame:
    """Per record read: page_id, payload_bytes, payload_digest, record_type and refers_to.

    Of a response these come from the payload itself, of a revisit from its headers.
    """
    response = F.col("headers")["warc-type"] == "response"
    page = lambda name: F.regexp_extract(F.col("headers")[name], r"<urn:page:(-?\d+)>", 1)
    number = lambda text: F.when(text != "", text).cast("long")
    return read.where("gap IS NULL").select(
        number(page("warc-record-id")).alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("headers")["http-content-length"].cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("headers")["payload-sha1"]).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        number(page("warc-refers-to")).alias("refers_to"),
    )
