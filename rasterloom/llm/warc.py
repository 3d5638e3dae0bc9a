"""WARC 1.1 archives: writing with revisit records, and a sequential reader.

Every record is a gzip member of its own.  The reader takes an archive front to back in small
chunks: zlib decompresses incrementally until a member ends, the header block ends at the first
empty line, Content-Length frames the record block, and SHA-1 digests of block and payload are
checked.  An archive is read by one task and is never held whole; one record is.

Archives lie in a folder that all executors reach (any store that pyarrow's file systems open).
Tasks write under names of their own and the manifest lists only what finished tasks wrote, so a
task that runs twice leaves a stray file, never a double record.

Defined cases: null html is the empty payload, null url leaves the target out, a null page_id gets a
random record id and reads back as null; rows that repeat the largest page_id of equal payloads
are all responses, and other repeated rows are records of their own; a long payload is read in chunks and
held once; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace

#: Payloads under this many bytes are always stored in full.
DEDUP_BYTES = 1000
#: An archive is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
_PREFIX = 0x7B1D5A60E4C84F21 << 64
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    value = uuid.uuid4() if page_id is None else uuid.UUID(int=_PREFIX | (page_id & (2**64 - 1)))
    return f"<urn:uuid:{value}>"


def page_of(record: str | None) -> int | None:
    if not record:
        return None
    value = uuid.UUID(record.strip("<>").rpartition(":")[2]).int
    if value >> 64 != _PREFIX >> 64:
        return None
    low = value & (2**64 - 1)
    return low - 2**64 if low >> 63 else low


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(kind: str, fields: dict[str, str | None], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}"]
    head += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    head += [f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def encode_page(row: dict[str, Any], date: str, level: int) -> bytes:
    """A response, or a revisit if the row has refers_to_set."""
    payload = (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = row["url"] and _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", row["url"])
    fields = {"WARC-Record-ID": record_id(row["page_id"]), "WARC-Date": date, "WARC-Target-URI": url or None, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": _sha1(payload)}
    if row["record_type"] == "revisit":
        return encode_record("revisit", fields | {"WARC-Profile": _REVISIT, "WARC-Refers-To": record_id(row["refers_to"])}, http, level)
    return encode_record("response", fields, http + payload, level)


def _members(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed members of an archive, one after the other."""
    left = b""
    while True:
        left = left or stream.read(CHUNK)
        if not left:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not left:
                left = stream.read(CHUNK)
                if not left:
                    raise ValueError("the archive ends inside a member")
            parts.append(unpacker.decompress(left))
            left = unpacker.unused_data if unpacker.eof else b""
        yield b"".join(parts)


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream: BinaryIO) -> Iterator[dict[str, Any]]:
    """Parse and verify every record; a framing or digest fault raises ValueError."""
    for member in _members(stream):
        end = member.find(b"\r\n\r\n")
        lines = member[:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("no WARC header")
        head = _fields(lines[1:])
        size = int(head["content-length"])
        block = member[end + 4 : end + 4 + size]
        if len(block) != size or member[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError("Content-Length does not frame the record")
        if "warc-block-digest" in head and head["warc-block-digest"] != _sha1(block):
            raise ValueError(f"block digest differs in {head.get('warc-record-id')}")
        payload, length = block, size
        if head.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n") + 4
            http = _fields(block[:cut].decode("latin-1").split("\r\n")[1:])
            payload, length = block[cut:], int(http.get("content-length", len(block) - cut))
        digest = head.get("warc-payload-digest", "")
        if head["warc-type"] == "response" and digest and digest != _sha1(payload):
            raise ValueError(f"payload digest differs in {head.get('warc-record-id')}")
        yield {
            "record_type": head["warc-type"], "record_id": head.get("warc-record-id"), "refers_to_id": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "payload_bytes": length, "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None, "payload": payload,
        }


RECORD = "record_type string, record_id string, refers_to_id string, target_uri string, date string, payload_bytes long, payload_digest string, page_id long, refers_to long"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Add record_type and refers_to: of equal payloads the largest page_id is the response.

    Only payloads that occur twice make rows of the joined side, so Spark can broadcast it if it is
    small and else splits a hot digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    first = rows.where(F.col("bytes") >= DEDUP_BYTES).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of mark_revisits() as archives in folder; lazily return the manifest
    (path, records, bytes), which has to be materialised once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is None:
                    name, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                    size += out.write(encode_record("warcinfo", {"WARC-Record-ID": record_id(None), "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", level))
                size += out.write(encode_page(row, date, level))
                count += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
            keep = [f"{scheme}{n}" if scheme == "file://" else f"{folder.rstrip('/')}/{n.rpartition('/')[2]}" for n, _, _ in done]
            yield pa.record_batch({"path": pa.array(keep), "records": pa.array([c for _, c, _ in done], pa.int64()), "bytes": pa.array([s for _, _, s in done], pa.int64())})

    return rows.mapInArrow(run, "path string, records long, bytes long")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives listed in manifest(path), a task an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in RECORD.split(", ")])
        if with_payload:
            schema = schema.append(pa.field("payload", pa.binary()))
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = FileSystem.from_uri(path)
                rows: list[dict[str, Any]] = []
                held = 0
                with store.open_input_stream(name, compression=None) as stream:
                    for record in read_records(stream):
                        held += len(record["payload"]) if with_payload else 200
                        if not with_payload:
                            del record["payload"]
                        rows.append(record | {"page_id": page_of(record["record_id"]), "refers_to": page_of(record["refers_to_id"])})
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    paths = manifest.select("path")
    tasks = max(1, min(manifest.count(), 20_000))
    return paths.repartition(tasks).mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def page_archive_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages(page_id, url, html) as archives in the shared folder, read them back, and return
    their response and revisit records without payloads."""
    work = Workspace(spark, "warc")
    manifest = work.keep(write_archives(mark_revisits(pages), f"{work.path}/archives"), "manifest")
    return read_archives(manifest, with_payload=False).where(F.col("record_type").isin("response", "revisit"))
