"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

The writer makes `response` records and, for payloads that another page carries too, `revisit` records that refer to it.
The reader loads the dictionary from the skippable frame, decodes frame by frame with bounded memory, and validates the
version, the mandatory headers, lengths, digests and record ends.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: Fixed values of the formats.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

LEVEL = 3
DICTIONARY_BYTES, DICTIONARY_PAGES = 64 << 10, 300
#: Bytes of records after which a task begins another archive, and bytes read at a time.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or with refers_to a revisit record, which holds the HTTP headers only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    head["WARC-Block-Digest"] = f"sha1:{digest(block)}"
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError if it is not well formed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not gap:
        raise ValueError(f"not a {VERSION.decode()} record: {first[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name in headers:
            raise ValueError(f"bad header line: {line[:80]!r}")
        headers[name] = value.strip()
    if missing := [x for x in MANDATORY if x not in headers]:
        raise ValueError(f"headers missing: {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4:
        raise ValueError(f"Content-Length {headers['Content-Length']}, but {len(rest) - 4} bytes before the end")
    if rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record's end is missing")
    block = rest[:-4]
    if headers.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("the block doesn't match its digest")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (None for a revisit) of a record."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind, name = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind not in ("response", "revisit") or not gap or length is None:
        raise ValueError(f"not a page's record: {kind}")
    if kind == "response" and (len(payload) != length or digest(payload) != name):
        raise ValueError("the payload doesn't match its length or digest")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in headers):
        raise ValueError("a revisit holds a payload or refers to nothing")
    ids = [headers[x].removeprefix("<urn:page:").removesuffix(">") if headers.get(x, "").startswith("<urn:page:") else "" for x in ("WARC-Record-ID", "WARC-Refers-To")]
    page_id, refers_to = (int(x) if x else None for x in ids)
    return page_id, headers.get("WARC-Target-URI"), length, name, kind, refers_to, payload if kind == "response" else None


class ArchiveWriter:
    """Writes records to a file, after the dictionary in a skippable frame (if there is one)."""

    def __init__(self, out: BinaryIO, dictionary: bytes | None):
        self.out, self.records = out, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)

    def write(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))
        self.records += 1


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of an archive's records, a frame at a time. ValueError if the archive is damaged or cut short."""
    data = source.read(READ_BYTES)
    dictionary = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            if not (more := source.read(READ_BYTES)):
                raise ValueError("the dictionary is cut short")
            data += more
        packed, data = data[8 : 8 + size], data[8 + size :]
        kind = struct.unpack("<I", packed[:4])[0] if size >= 4 else 0
        if kind not in (FRAME, DICTIONARY):
            raise ValueError("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed) if kind == FRAME else packed)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := source.read(READ_BYTES)):
        frame = decoder.decompressobj()
        parts = []
        try:
            while not frame.eof:
                if not data and not (data := source.read(READ_BYTES)):
                    raise ValueError("the last frame is cut short")
                parts.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else b""
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame can't be decoded: {e}") from e
        yield parse(b"".join(parts))


def train_dictionary(pages: DataFrame, most: int = DICTIONARY_PAGES) -> bytes | None:
    """A dictionary from records of at most `most` pages, those of the smallest hashes; None if they are too few or small."""
    ids = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    sample = pages.join(F.broadcast(ids), "page_id").where(F.octet_length("html") <= 64 << 10).select("page_id", "url", "html").limit(2 * most).toArrow()
    rows = sorted(sample.to_pylist(), key=lambda r: (r["page_id"], r["url"] or "", r["html"]))
    samples = [record(r["page_id"], r["url"], r["html"].encode(), None) for r in rows]
    if sum(map(len, samples)) < 10 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def with_references(pages: DataFrame) -> DataFrame:
    """Pages with refers_to: of rows with equal payloads (null as empty), the largest page_id, for all rows but its own."""
    # Two narrow passes over the digests; the pages themselves are shuffled only if many of them repeat another.
    keyed = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("print"))
    shared = keyed.groupBy("print").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    repeats = common.materialize(keyed.join(shared, "print").where("page_id < refers_to").select("page_id", "print", "refers_to").distinct(), "repeats")
    few = repeats.count() <= common.BROADCAST_IDS // 4
    return pages.withColumn("print", F.sha1(F.coalesce("html", F.lit("")))).join(F.broadcast(repeats) if few else repeats, ["page_id", "print"], "left").drop("print")


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None) -> DataFrame:
    """Write a record for each row (page_id, url, html, refers_to) to archives in the folder; returns (path, records).

    A path is listed once its task has ended well; files of lost attempts are listed nowhere and never read.
    """
    common.long_rows(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name, out, archive, size, done = "", None, None, 0, []
        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.bytes_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    if archive is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        out = store.open_output_stream(f"{at}/{name}")
                        archive, size = ArchiveWriter(out, shared.value), 0
                    data = record(page_id, url, html, refers_to)
                    archive.write(data)
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((f"{folder}/{name}", archive.records))
                        archive = None
        finally:
            if out is not None:
                out.close()
        if archive is not None:
            done.append((f"{folder}/{name}", archive.records))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), "refers_to"]
    return pages.select(*columns).mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives listed in `path`: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    and with `payloads` the payload (null for a revisit). A damaged archive fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
        names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(at) as source:
                    for headers, block in read_records(source):
                        rows.append(page_of(headers, block)[: len(names)])
                        if len(rows) >= common.TEXT_BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    spread = archives.select("path").repartition(common.partitions(archives.sparkSession))
    return spread.mapInArrow(run, RECORDS + ", payload binary" * payloads)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write every page to archives and read them back; one row per row of pages.

    Needs columns page_id, url and html; others are ignored. The payload is the html in UTF-8 (null: empty). Rows with a
    null page_id are responses of their own, whose record has a random id, and read back with page_id null; responses, too, are repeated rows of the largest page_id
    of a payload. An empty table gives no rows.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    folder = folder or common.scratch_path(spark, "archives")
    folder = common.qualified(spark, folder)
    folder = f"file://{folder.removeprefix('file:')}" if folder.startswith("file:/") and not folder.startswith("file://") else folder
    written = common.materialize(write_archives(with_references(plain), folder, train_dictionary(plain)), "manifest")
    return read_archives(written, payloads)
