"""WARC archives with a Zstandard dictionary, written and read back.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame for each record.
The dictionary is built once, from records as they are archived: of at most ``2 * SAMPLE`` pages, whose
ids are chosen by a hash, each gives its record, or ``CHUNKS`` evenly spread parts of it that make
``PART`` bytes. Records with equal payloads are told by SHA-1: the one with the least page_id is a
response, the others revisit it. The list of repeated payloads is broadcast if it is short; beyond
that the pages are joined with it, those of very frequent payloads still by a broadcast. Tasks write
their archives to the shared folder under names of their own and report them in a manifest table; an
attempt that is lost never reaches the manifest.

Defined results: a null payload is empty, and empty payloads are equal. Very long payloads are one
record each, in memory in proportion to the longest one. Rows that share the least page_id of a payload
are all responses, so repeated rows are. A null page_id is never the least unless the payload has no
other id, and then all its rows are responses. Tables without rows give no archive. Columns beside
page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import LISTED, SLICE_ROWS, hashed_sample, materialize, shared_dir

SKIPPABLE = 0x184D2A5D
SAMPLE, DICTIONARY = 500, 65_536
#: Bytes of a sampled record that build the dictionary, and the parts they come in.
PART, CHUNKS = 16_384, 16
#: Pages of one payload above which they are not shuffled to it.
HOT = 100_000
#: Bytes of records, before compression, after which a task begins another archive.
ARCHIVE = 64 << 20
LEVEL, DATE = 3, "2024-01-01T00:00:00Z"


def store(uri: str):
    """(file system, path) of a folder that executors share."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def record(page, url: str | None, payload: bytes, digest: str, refers, date: str) -> bytes:
    """A response, or a revisit (without payload) if ``refers`` is not None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """Archives of one task."""

    def __init__(self, uri: str, dictionary: bytes):
        self.fs, self.dir = store(uri)
        self.dictionary = dictionary
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.out, self.done = None, []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name, self.size, self.n = f"{self.dir}/{uuid.uuid4().hex}.warc.zst", 0, 0
            self.out = self.fs.open_output_stream(self.name, compression=None)  # not by the suffix
            self.out.write(struct.pack("<II", SKIPPABLE, len(self.dictionary)) + self.dictionary)
        self.out.write(self.packer.compress(raw))
        self.size, self.n = self.size + len(raw), self.n + 1
        if self.size >= ARCHIVE:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.n))
            self.out = None


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive that is open for reading."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    plain = io.BufferedReader(unpacker.stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(": ")
            headers[name] = value.rstrip("\r\n")
        block = plain.read(int(headers["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def resolved(pages: DataFrame, limit: int = LISTED, hot: int = HOT) -> DataFrame:
    """(page_id, url, html, digest, refers): refers is the response that a page revisits."""
    pages = pages.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = pages.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = materialize(first, "repeated")
    if first.count() <= limit:
        rows = pages.join(F.broadcast(first.drop("n")), "digest", "left")
    else:
        often = F.broadcast(first.filter(F.col("n") > hot).drop("n"))  # at most rows / hot payloads
        rest = pages.join(often, "digest", "left_anti").join(first.filter(F.col("n") <= hot).drop("n"), "digest", "left")
        rows = pages.join(often, "digest").unionByName(rest)
    return rows.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))


def spread_parts(raw: bytes) -> bytes:
    """A record of at most PART bytes, or evenly spread parts of it that make as many."""
    if len(raw) <= PART:
        return raw
    size = PART // CHUNKS
    return b"".join(raw[at : at + size] for at in ((len(raw) - size) * i // (CHUNKS - 1) for i in range(CHUNKS)))


def sampled_records(rows: DataFrame, ids: DataFrame, date: str, sample: int = SAMPLE) -> list[bytes]:
    """What the dictionary is built from: records, or parts of them, of at most ``2 * sample`` pages."""
    some = rows.join(F.broadcast(ids), "page_id", "left_semi")  # at most `sample` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                parts = [spread_parts(record(page, url, html.encode(), base64.b32encode(digest).decode(), refers, date)) for page, url, html, digest, refers in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["raw"])

    return [bytes(r["raw"]) for r in some.mapInArrow(run, "raw binary").limit(2 * sample).collect()]  # ids may repeat


def write_archives(pages: DataFrame, uri: str | None = None, date: str = DATE) -> DataFrame:
    """Write a record per page; (path, n_records) of each archive, read from the manifest."""
    spark = pages.sparkSession
    uri = uri or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files, path = store(uri)
    files.create_dir(path, recursive=True)
    rows = resolved(pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")))
    ids = hashed_sample(pages.select("page_id").filter("page_id is not null"), "page_id", SAMPLE).distinct()
    dictionary = build_dictionary(sampled_records(rows, ids, date))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(uri, dictionary)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    w.add(record(page, url, html.encode(), base64.b32encode(digest).decode(), refers, date))
        w.close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in w.done], pa.string()), pa.array([n for _, n in w.done], pa.int64())], names=["path", "n_records"])

    return materialize(rows.mapInArrow(run, "path string, n_records long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, uri: str, page_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and with
    ``payloads`` the response's payload. Digests of responses are checked."""
    files = max(1, manifest.count())
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if payloads else [])]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, _ = store(uri)

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for some in batches:
            for path, expected in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                rows, n = [], 0
                with file_system.open_input_stream(path, compression=None) as f:
                    for head, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].partition(":")[2]
                        kind = head["WARC-Type"]
                        if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{path}: a payload does not match its digest")
                        page = head["WARC-Record-ID"][len("<urn:page:") : -1]
                        refers = head["WARC-Refers-To"][len("<urn:page:") : -1] if kind == "revisit" else None
                        rows.append((page or None, length, digest, kind, refers, *([payload] if payloads else [])))
                        n += 1
                        if len(rows) >= 1024:
                            yield batch(rows)
                            rows = []
                if n != expected:
                    raise ValueError(f"{path} has {n} records, its manifest {expected}")
                if rows:
                    yield batch(rows)

    out = manifest.select("path", "n_records").repartition(min(files, 10_000)).mapInArrow(run, schema)
    return out.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives, then read the archives back."""
    uri = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, uri)
    return read_archives(pages.sparkSession, manifest, uri, pages.schema["page_id"].dataType.simpleString())
