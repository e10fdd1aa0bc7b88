"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress alone; a footer (a skippable frame in the seekable format) lists
the frames' sizes, and an index row maps each record to its frame and its offset in the decompressed frame. Equal
payloads are stored once: the record with the largest key is the response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

FRAME_BYTES = 256 * 1024
#: Numbers of the seekable Zstandard format (fixed values).
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

INDEX_SCHEMA = "record_id string, key long, path string, frame int, offset long, length long"
READ_SCHEMA = "record_id string, key long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    """Base32 SHA-1 as WARC headers carry it, without the algorithm's name."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str):
    """(file system, path in it) of a URI; a bare path is local."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file://" + "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record_id(key, payload_digest: str, place: str = "") -> str:
    """The id of a record that alone has its key and payload; others have their place in the archive in it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'record {key} {payload_digest} {place}')}>"


def render_record(key, uri: str | None, payload: bytes, refers_to, place: str = "", target_alone: bool = True) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) keeps the digest and the size, not the payload. Several responses
    may have the key that it refers to; then there is no one id to name."""
    own = digest(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, own, place)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{own}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if key is not None:
        head.append(f"WARC-Record-Key: {key}")
    if uri is not None:
        head.insert(4, "WARC-Target-URI: " + " ".join(uri.split()))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head[3:3] = [
            *[f"WARC-Refers-To: {record_id(refers_to, own)}"] * target_alone,
            f"WARC-Refers-To-Key: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record that render_record made."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Writes frames of about frame_bytes to an open binary stream, then the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self._stream, self._most, self._zip = stream, frame_bytes, zstandard.ZstdCompressor(level=3)
        self._held, self._size, self._frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the decompressed frame) of the record."""
        if self._size and self._size + len(record) > self._most:
            self._flush()
        at = len(self._frames), self._size
        self._held.append(record)
        self._size += len(record)
        return at

    def _flush(self) -> None:
        frame = self._zip.compress(b"".join(self._held))
        self._stream.write(frame)
        self._frames.append((len(frame), self._size))
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._size:
            self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self._frames)
        footer = struct.pack("<IBI", len(self._frames), 0, SEEKABLE_MAGIC)
        self._stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class BundleReader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, file):
        self._file, size = file, file.size()
        file.seek(size - FOOTER_BYTES)
        count, _, magic = struct.unpack("<IBI", file.read(FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        file.seek(size - FOOTER_BYTES - 8 * count)
        self._frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
            self._frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        import zstandard

        at, packed, plain = self._frames[number]
        self._file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self._file.read(packed), max_output_size=plain)


def roles(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """key, sha, refers_to (null for a response), alone (whether no other row has this key and payload) and target_alone
    (the same of what it refers to), once for each (key, sha) in records(key, uri, payload) that is a revisit or not alone."""
    seen = records.select("key", F.sha1(F.coalesce("payload", F.lit(b""))).alias("sha"), F.coalesce(F.octet_length("payload"), F.lit(0)).alias("size"))
    seen = cut(seen.groupBy("key", "sha").agg(F.count("*").alias("rows"), F.max("size").alias("size")))
    last = seen.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.count("*").alias("keys"), F.max(F.struct("key", "rows")).alias("last"))
    found = seen.join(last.where("keys > 1"), "sha", "left")
    refers = F.when(F.col("key") != F.col("last.key"), F.col("last.key"))
    found = found.select("key", "sha", refers.alias("refers_to"), (F.col("rows") == 1).alias("alone"), F.coalesce(F.col("last.rows") == 1, F.lit(True)).alias("target_alone"))
    return found.where("refers_to IS NOT NULL OR NOT alone")


def write(records: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes records(key long, uri string, payload binary) as bundles in folder, one per task, and returns their
    index (INDEX_SCHEMA). A null payload is empty, a null uri has no header. Rows with the same key and payload become as
    many records of one kind: of the largest key all are responses, as nothing tells them apart. Every record has an id
    of its own. A row with a null key is a response that nothing refers to. A task that is run again writes a new file;
    the index names only files of tasks that ended."""
    keyed = records.select(F.col("key").cast("long"), F.col("uri").cast("string"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    part = roles(keyed, min_bytes).withColumnsRenamed({"key": "role_key", "sha": "role_sha"})
    same = (F.col("sha") == F.col("role_sha")) & F.col("key").eqNullSafe(F.col("role_key"))
    to_write = keyed.withColumn("sha", F.sha1("payload")).join(part, same, "left")  # records without a copy have no row there
    to_write = to_write.select("key", "uri", "payload", "refers_to", F.coalesce("alone", F.lit(True)).alias("alone"), F.coalesce("target_alone", F.lit(True)).alias("target_alone"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store = path = stream = bundle = None
        n_records = 0
        for batch in batches:
            rows = []
            for key, uri, payload, refers_to, alone, target_alone in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    store, path = filesystem(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                    stream = store.open_output_stream(path + ".part")
                    bundle = BundleWriter(stream, frame_bytes)
                place = "" if alone else f"{path.rpartition('/')[2]} {n_records}"
                record = render_record(key, uri, payload, refers_to, place, target_alone)
                rows.append((record_id(key, digest(payload), place), key, path.rpartition("/")[2], *bundle.add(record), len(record)))
                n_records += 1
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names="record_id key path frame offset length".split())
        if bundle is not None:
            bundle.close()
            stream.close()
            store.move(path + ".part", path)

    make_folder(folder)
    return cut(to_write.mapInArrow(run, INDEX_SCHEMA))


def make_folder(folder: str) -> None:
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)


def read(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that index names (READ_SCHEMA), each frame decompressed once per run of its records. The size
    and the digest of a response are taken from the payload read, and must agree with its headers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name, reader, file, number, frame = None, None, None, -1, b""
        for batch in batches:
            rows = []
            for path, at, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offset", "length"))):
                if path != name:
                    if file is not None:
                        file.close()
                    store, full = filesystem(f"{folder}/{path}")
                    file = store.open_input_file(full)
                    name, reader, number = path, BundleReader(file), -1
                if at != number:
                    number, frame = at, reader.frame(at)
                fields, payload = parse_record(frame[offset : offset + length])
                kind, size, sha = fields["WARC-Type"], int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload), digest(payload)) != (size, sha):
                    raise ValueError(f"record {fields['WARC-Record-ID']} in {path} is damaged")
                to = fields.get("WARC-Refers-To-Key")
                key = fields.get("WARC-Record-Key")
                rows.append((fields["WARC-Record-ID"], key and int(key), fields.get("WARC-Target-URI"), size, sha, kind, to and int(to), payload if with_payload else None))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names="record_id key uri payload_bytes payload_digest record_type refers_to payload".split())

    placed = index.repartition("path").sortWithinPartitions("path", "frame", "offset")
    return placed.mapInArrow(run, READ_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives; cases as in write."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload"))
    folder = f"{shared_dir(spark)}/lodestar/warc-{uuid.uuid4().hex}"
    back = read(write(pages, folder), folder, with_payload=False)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


#: DuckDB SQL for op2_warc; every five hexadecimal digits of a SHA-1 are four of base32.
OP2_SQL = """
WITH read AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
placed AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS first FROM read)
SELECT page_id, url AS uri, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM placed
"""
