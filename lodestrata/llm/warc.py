"""Operator 8: WARC records in seekable Zstandard bundles.

A bundle is a file image: independent Zstandard frames of several records each, then a skippable
frame with the seek table (compressed and decompressed size of every frame) and its footer, as the
public seekable format has it. ``index`` maps a record to its bundle, its frame and its offset in
the decompressed frame, so one record costs the seek table and one frame.

Records with equal payloads of ``REVISIT_BYTES`` or more are stored once: the least id is the
response, the others revisit it. Which is which comes from an aggregate of digests; page bodies are
shuffled once, to meet it. Bundles are rows of a Parquet table, so Spark's own committer writes
them to any shared store and a lost task leaves nothing behind; ``save_files`` writes them out as
files of their own, ``read_files`` reads such files and those of other writers.

``read_bundles`` goes through the index: the records of a frame are found by their offsets in it.

Defined results: a null payload is an empty one; payloads below the bound are all responses; a null
id is written as the empty one and comes back null, always as a response. Rows with equal ids are
told apart by their payloads; rows with equal ids and payloads are stored each, of equal type. White
space in a URL is percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import prepare

REVISIT_BYTES = 100
FRAME_BYTES = 1 << 17
BUNDLE_BYTES = 1 << 23
LEVEL = 3
#: Fixed by the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: The date every record carries; runs give equal bundles.
RECORD_DATE = "2000-01-01T00:00:00Z"
_SPACE = re.compile(r"[\s\x00-\x1f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BUNDLE_SCHEMA = "bundle long, content binary, index array<struct<id:string,frame:int,offset:long,length:long>>"


def record(kind: str, number: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header alone; digest and size are of the full payload."""
    body = _HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{number}>", f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {_SPACE.sub(lambda m: quote(m[0]), url or '')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end where it says")
    return head, data[begin:end], end + 4


class BundleWriter:
    """Groups records into frames and appends the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open = bytearray()
        self.held = 0

    def add(self, number: str, data: bytes) -> None:
        self.index.append({"id": number, "frame": len(self.frames), "offset": len(self.open), "length": len(data)})
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        frame = self.compressor.compress(bytes(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), len(self.open)))
        self.held += len(frame)
        self.open.clear()

    def finish(self) -> bytes:
        if self.open:
            self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of every frame, read from the footer backwards."""
    frames, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    start = len(bundle) - 9 - width * frames
    if struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE_MAGIC, width * frames + 9):
        raise ValueError("broken seek table")
    out, place = [], 0
    for n in range(frames):
        size, full = struct.unpack("<II", bundle[start + width * n : start + width * n + 8])
        out.append((place, size, full))
        place += size
    return out


def read_frame(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    place, size, full = entry
    return zstandard.ZstdDecompressor().decompress(bundle[place : place + size], max_output_size=full)


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """The record at a frame-relative offset; reads the seek table and that frame only."""
    head, block, _ = parse(read_frame(bundle, seek_table(bundle)[frame]), offset)
    return head, block


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(body.cast("binary"), F.lit(b"")), 256))


def decide(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(id, digest, refers_to) of the records that revisit another."""
    keyed = pages.filter(F.col(id_column).isNotNull() & (F.length(F.col(html_column).cast("binary")) >= least)).select(F.col(id_column).alias("id"), _digest(F.col(html_column)).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    return keyed.join(first, "digest").filter("id > first").select("id", "digest", F.col("first").alias("refers_to")).distinct()


def bundles(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """One row per bundle: its number, its bytes and the index of its records."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).cast("binary").alias("html"), _digest(F.col(html_column)).alias("digest"))
    rows = rows.join(decide(pages, id_column, html_column, least), ["id", "digest"], "left").select(F.col("id").cast("string"), F.col("refers_to").cast("string"), "url", "html")
    index_type = pa.list_(pa.struct([("id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        number, writer = TaskContext.get().partitionId() << 32, BundleWriter(frame_bytes)

        def done() -> pa.RecordBatch:
            content = writer.finish()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([content], pa.binary()), pa.array([writer.index], index_type)], names=["bundle", "content", "index"])

        for batch in batches:
            for page, refers_to, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html or b""
                kind = "response" if refers_to is None else "revisit"
                writer.add(page or "", record(kind, page or "", url, payload, sha256(payload).hexdigest(), refers_to))
                if writer.held >= bundle_bytes:
                    yield done()
                    number, writer = number + 1, BundleWriter(frame_bytes)
        if writer.index:
            yield done()

    return rows.mapInArrow(run, BUNDLE_SCHEMA)


_READ = {"id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string()}
_READ_SCHEMA = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _described(head: dict[str, str], block: bytes) -> tuple:
    """What is known of a record; a response's size and digest are taken from its payload, a revisit's from its header."""
    from hashlib import sha256

    payload, refers_to = block.partition(b"\r\n\r\n")[2], head.get("WARC-Refers-To")
    if head["WARC-Type"] == "response":
        size, digest = len(payload), sha256(payload).hexdigest()
    else:
        size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2]
    return head["WARC-Record-ID"][10:-1] or None, size, digest, head["WARC-Type"], refers_to and refers_to[10:-1]


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def read_bundles(stored: DataFrame, id_type: str = "long", id_column: str = "page_id") -> DataFrame:
    """Every indexed record of stored bundles, found by frame and offset: id, payload_bytes, payload_digest, record_type, refers_to."""
    prepare(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames, at, data, rows = seek_table(bundle), -1, b"", []
                for entry in index:  # in the order of the frames, so each is read once
                    if entry["frame"] != at:
                        if rows:
                            yield _table(rows, _READ)
                        at, rows = entry["frame"], []
                        data = read_frame(bundle, frames[at])
                    head, block, end = parse(data, entry["offset"])
                    if end - entry["offset"] != entry["length"] or head["WARC-Record-ID"] != f"<urn:page:{entry['id']}>":
                        raise ValueError(f"the index does not point at record {entry['id']}")
                    rows.append(_described(head, block))
                yield _table(rows, _READ)

    found = stored.select("content", "index").mapInArrow(run, _READ_SCHEMA)
    return found.select(F.col("id").cast(id_type).alias(id_column), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def save_files(stored: DataFrame, folder: str) -> DataFrame:
    """Writes each stored bundle to ``folder`` as a file of its own and returns (bundle, path, size). Runs when the result is read.

    The folder has to be one that all executors share. A file gets its name when it is whole, and a
    task that runs again writes the same file.
    """
    prepare(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow.fs import FileSystem, LocalFileSystem

        files, root = FileSystem.from_uri(folder) if ":/" in folder else (LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for bundle, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, part = f"{root}/{bundle:020d}.warc.zst", f"{root}/.{uuid4().hex}.part"
                with files.open_output_stream(part) as out:
                    out.write(content)
                files.move(part, path)
                rows.append((bundle, path, len(content)))
            yield _table(rows, {"bundle": pa.int64(), "path": pa.string(), "size": pa.int64()})

    return stored.select("bundle", "content").mapInArrow(run, "bundle long, path string, size long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, record_id, record_type, url, block) of ``.warc.zst`` files of any writer, seek table or not; files below 2 GB."""
    prepare(spark)
    kinds = {"path": pa.string(), "place": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "block": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) as stream:
                    held, place, ended = b"", 0, False
                    while not ended or held:
                        while not ended and len(held) < FRAME_BYTES:
                            more = stream.read(FRAME_BYTES)
                            held, ended = held + more, not more
                        try:
                            head, block, end = parse(held)
                        except (ValueError, IndexError):
                            if ended:
                                if held.strip():
                                    raise
                                break
                            more = stream.read(max(FRAME_BYTES, len(held)))
                            held, ended = held + more, not more
                            continue
                        yield _table([(name, place, head.get("WARC-Record-ID"), head.get("WARC-Type"), head.get("WARC-Target-URI"), block)], kinds)
                        held, place = held[end:], place + 1

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, place long, record_id string, record_type string, url string, block binary")
