"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with many WARC records, and a seek table in a skippable frame
at its end, so that a reader finds any frame without reading the others. An index maps each record identifier to its
bundle, frame and offset within the frame's records. Of records with equal payloads of at least 100 bytes the one with
the smallest page_id holds the payload, the others revisit it.

Bundles are written under a name of their own in each try and only named by the index that Spark commits, so a task
that is run again leaves no wrong file in use. Payloads are shuffled once, by page_id, to meet their decision.

Defined cases: null html is an empty payload; a null url leaves the target out; a null page_id is always a response.
Rows of one page_id with equal html are all decided alike. Empty tables give no bundles. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import attach, materialize, new_path, small_batches, text_or_empty

#: Bytes of records in a frame, and compressed bytes of a bundle, from which the next is begun.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: Equal payloads below this many bytes are stored again.
LEAST_REVISIT = 100
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "record_id string, page_id long, bundle string, frame int, frame_at long, frame_size long, at long, size long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _line(value: str) -> str:
    """A header's value: characters that would end its line are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """The identifier and the bytes of a record."""
    name = f"<urn:page:{'null-' + uuid.uuid4().hex if page_id is None else page_id}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + payload if refers_to is None else http
    head.append(f"Content-Length: {len(block)}")
    return name, ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record in a frame's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end: compressed and plain size of each frame."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of each frame, of an open bundle."""
    total = f.size()
    f.seek(total - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(total - 9 - 8 * count)
    sizes = [struct.unpack("<II", f.read(8)) for _ in range(count)]
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


class BundleWriter:
    """Appends records to bundles in a folder; index rows come out with the frame that holds them."""

    def __init__(self, uri: str, frame_bytes: int, bundle_bytes: int):
        self.fs, self.folder = _filesystem(uri)
        self.uri, self.frame_bytes, self.bundle_bytes = uri, frame_bytes, bundle_bytes
        self.fs.create_dir(self.folder, recursive=True)
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.file, self.held, self.names = None, bytearray(), []

    def add(self, name: str, page_id: int | None, data: bytes) -> list[tuple]:
        self.names.append((name, page_id, len(self.held), len(data)))
        self.held += data
        return self.flush() if len(self.held) >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.names:
            return []
        if self.file is None:
            self.bundle = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.file, self.frames, self.at = self.fs.open_output_stream(f"{self.folder}/{self.bundle}", compression=None), [], 0
        packed = self.pack.compress(bytes(self.held))
        self.file.write(packed)
        rows = [(name, page_id, f"{self.uri}/{self.bundle}", len(self.frames), self.at, len(packed), at, size) for name, page_id, at, size in self.names]
        self.frames.append((len(packed), len(self.held)))
        self.at += len(packed)
        self.held, self.names = bytearray(), []
        if self.at >= self.bundle_bytes:
            self.close()
        return rows

    def close(self) -> None:
        if self.file is not None:
            self.file.write(seek_table(self.frames))
            self.file.close()
            self.file = None


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the pages that repeat an earlier payload; pages has digest and n_bytes."""
    rows = materialize(pages.filter(F.col("n_bytes") >= LEAST_REVISIT).select("page_id", "digest"), "warc-digests")
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = attach(rows, materialize(groups, "warc-groups"), ["digest"], "n", rows.count())
    return found.filter("page_id > first").groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))


def write_archives(pages: DataFrame, uri: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to bundles in the folder uri; returns the index."""
    small_batches(pages.sparkSession, 500)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_or_empty("html").alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "n_bytes": F.octet_length("html")})
    decided = rows.join(revisits(rows).hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to")
    fields = INDEX.replace(",", "").split()
    names = fields[::2]
    types = dict(zip(("string", "long", "int"), (pa.string(), pa.int64(), pa.int32()), strict=True))
    kinds = [types[x] for x in fields[1::2]]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BundleWriter(uri, frame_bytes, bundle_bytes)
        to_batch = lambda found: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, data = record(page_id, url, html, digest, refers_to, date)
                if found := out.add(name, page_id, data):
                    yield to_batch(found)
        if found := out.flush():
            yield to_batch(found)
        out.close()

    return materialize(decided.mapInArrow(write, INDEX), "warc-index")


def _row(head: dict[str, str], block: bytes) -> dict:
    """A record's row. The payload of a response is held against its digest."""
    kind, name = head["WARC-Type"], head["WARC-Record-ID"][len("<urn:page:") : -1]
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
    payload = None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if f"sha256:{digest}" != head["WARC-Payload-Digest"]:
            raise ValueError(f"{name}: the payload is damaged")
    refers = head.get("WARC-Refers-To")
    return {"page_id": None if name.startswith("null-") else int(name), "url": head.get("WARC-Target-URI"), "record_type": kind, "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None, "payload": payload, "payload_bytes": size, "payload_digest": digest}


def _schema(names: list[str]) -> tuple[str, pa.Schema]:
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return ", ".join(x.strip() for x in RECORD.split(",") if x.split()[0] in names), pa.schema([(x.split()[0], types.get(x.split()[0], pa.string())) for x in RECORD.split(",") if x.split()[0] in names])


def read_archives(index: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All records of the bundles that an index names, by their seek tables; names: the columns of RECORD to return."""
    names = names or [x.split()[0] for x in RECORD.split(",")]
    said, schema = _schema(names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                system, path = _filesystem(bundle)
                with system.open_input_file(path) as f:
                    for at, packed, plain in read_seek_table(f):
                        f.seek(at)
                        data = unpack.decompress(f.read(packed), max_output_size=plain)
                        rows = [_row(head, block) for _, head, block in parse_records(data)]
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)

    bundles = materialize(index.select("bundle").distinct(), "warc-bundles")
    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(read, said)


def read_records(wanted: DataFrame) -> DataFrame:
    """The records of some index rows: only the frames that hold them are read."""
    said, schema = _schema([x.split()[0] for x in RECORD.split(",")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, have, data = zstandard.ZstdDecompressor(), None, b""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if have != (r["bundle"], r["frame"]):
                    system, path = _filesystem(r["bundle"])
                    with system.open_input_file(path) as f:
                        f.seek(r["frame_at"])
                        data = unpack.decompress(f.read(r["frame_size"]))
                    have = (r["bundle"], r["frame"])
                _, head, block = next(parse_records(data[r["at"] : r["at"] + r["size"]]))
                out.append(_row(head, block))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return wanted.sortWithinPartitions("bundle", "frame", "at").mapInArrow(read, said)


def page_records(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, read them back, and return a row for each record."""
    index = write_archives(pages, new_path(pages.sparkSession, "warc"))
    return read_archives(index, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
