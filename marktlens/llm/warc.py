r"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC
records up to about ``frame_bytes``, then a skippable frame with the seek
table of the public seekable format (per frame: compressed size, size,
checksum; footer with the number of frames). Any Zstandard tool can unpack a
bundle; a reader that knows the seek table unpacks just the frame it needs.
The index maps each record to (bundle, frame, offset, length), the offset
being relative to its frame.

Of records with equal payloads of at least ``min_dedup_bytes``, the one with
the largest id is the response and the others are revisits that refer to it.
Payloads are grouped by digest after a pre-aggregation, so a payload that a
third of all pages share is one row of the smaller side of a join, which is
broadcast where its counted size allows: then no payload is shuffled. Reading
deals frames to as many tasks as the records' bytes ask for. Each task
streams its own bundles into the shared folder under a name of its attempt;
the index, written afterwards, names the bundles that count, so what lost
tasks left behind is never read.

Defined results: a null payload is empty; a null url has no
field and a null id is written as "null", and both are read back as null; repeated rows of one id and payload
are all responses if that id is the largest; equal payloads without any id
are all responses; an empty table writes no bundle; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_small, materialise, table

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

URN = "urn:marktlens:page:"
INDEX = "id long, bundle string, frame int, offset long, length long"
READ = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    fields = [
        ("WARC-Record-ID", f"<{URN}{'null' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        *([] if url is None else [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))]),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if revisit:
        return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>"), ("Content-Type", "application/http; msgtype=response")], http)
    return record("response", [*fields, ("Content-Type", "application/http; msgtype=response")], http + payload)


class BundleWriter:
    """One bundle: add() takes a record and returns its (frame, offset); close() appends the seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int) -> None:
        fs, path = open_at(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.frame_bytes, self.pack = fs.open_output_stream(path, compression=None), frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frame, self.table, self.size = bytearray(), [], 0

    def add(self, raw: bytes) -> tuple[int, int]:
        if self.frame and len(self.frame) + len(raw) > self.frame_bytes:
            self.flush()
        at = (len(self.table), len(self.frame))
        self.frame += raw
        return at

    def flush(self) -> None:
        plain = bytes(self.frame)
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.size += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self.flush()
        entries = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries)
        self.out.close()


class BundleReader:
    """Unpacks single frames by the seek table at a bundle's end."""

    def __init__(self, uri: str) -> None:
        fs, path = open_at(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri}: no seek table")
        width = 12 if flags & CHECKSUM_FLAG else 8
        raw = self.file.read_at(frames * width, size - 9 - frames * width)
        self.frames, at = [], 0
        for i in range(frames):
            packed, plain, *check = struct.unpack_from("<III" if width == 12 else "<II", raw, i * width)
            self.frames.append((at, packed, plain, check))
            at += packed

    def frame(self, n: int) -> bytes:
        at, packed, plain, check = self.frames[n]
        out = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
        if check and check[0] != xxhash.xxh64_intdigest(out) & 0xFFFFFFFF:
            raise ValueError(f"frame {n}: checksum")
        return out

    def close(self) -> None:
        self.file.close()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields in lower case, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v[1:] for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length")
    return fields, block


def write_task(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, bundle_bytes: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    writer, rows, schema = None, [], pa.schema([("id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    name = ""
    for batch in batches:
        for page_id, url, payload, refers_to in zip(*(batch[c] for c in ("id", "url", "payload", "refers_to")), strict=True):
            if writer is None:
                name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                writer = BundleWriter(name, frame_bytes, level)
                writer.add(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            body = payload.as_py()
            raw = page_record(page_id.as_py(), url.as_py(), body, digest(body), refers_to.as_py(), date)
            rows.append((page_id.as_py(), name, *writer.add(raw), len(raw)))
            if writer.size >= bundle_bytes:
                writer.close()
                writer = None
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)
        rows = []
    if writer is not None:
        writer.close()


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 256 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write bundles into folder and return their index (id, bundle, frame, offset, length), itself kept there."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("payload", 256)), "bytes": F.octet_length("payload")})
    held = rows.where(F.col("bytes") >= min_dedup_bytes).groupBy("sha").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    held = materialise(held, "warc-held")
    rows = join_small(rows, held, "sha", "left", row_bytes=56)
    refers = F.when((F.col("bytes") >= min_dedup_bytes) & ~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    rows = rows.select("id", "url", "payload", refers.alias("refers_to"))
    task = partial(write_task, folder=folder, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, level=level, date=date)
    return materialise(rows.mapInArrow(task, INDEX), "warc-index")


def read_task(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    bundles: dict[str, BundleReader] = {}
    at, plain = None, b""
    names = ["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda urn: None if urn is None or urn == f"<{URN}null>" else int(urn[len(URN) + 1 : -1])
    for batch in batches:
        rows = []
        for bundle, frame, offset, length in zip(*(batch[c].to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
            if (bundle, frame) != at:
                if bundle not in bundles:
                    if len(bundles) >= 64:  # open files at once
                        bundles.pop(next(iter(bundles))).close()
                    bundles[bundle] = BundleReader(bundle)
                at, plain = (bundle, frame), bundles[bundle].frame(frame)
            fields, block = parse_record(plain[offset : offset + length])
            kind, payload = fields["warc-type"], block.partition(b"\r\n\r\n")[2]
            said = fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and digest(payload) != said:
                raise ValueError(f"{fields['warc-record-id']}: payload digest")
            size = len(payload) if kind == "response" else int(fields["warc-payload-length"])
            rows.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), payload if with_payload and kind == "response" else None, size, said, kind, number(fields.get("warc-refers-to"))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    for b in bundles.values():
        b.close()


def read_warc(index: DataFrame, with_payload: bool = True, task_bytes: int = 64 << 20) -> DataFrame:
    """Every record that index names, read back from its frame; a frame is unpacked once, and a task reads some task_bytes of records."""
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // task_bytes), index.sparkSession.sparkContext.defaultParallelism)
    rows = index.select("bundle", "frame", "offset", "length").repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return rows.mapInArrow(partial(read_task, with_payload=with_payload), READ)


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back from the bundles."""
    index = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_warc(index, with_payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (SELECT g.*, list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform(range(4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 5 * i)::BIGINT, 5))::BIGINT >> (15 - 5 * j)::BIGINT) & 31)::BIGINT, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest FROM g)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM b
"""
