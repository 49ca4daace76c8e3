"""Dictionary-compressed WARC archives (.warc.zst) of pages, written and read by tasks.

A task trains a Zstandard dictionary from the first records that it archives (up to ``sample_bytes``), puts it into a
skippable frame at the head of each of its archives, and compresses every record as a frame of its own, so a reader
needs no other file and can begin at any record. Archives are closed at ``archive_bytes`` of records, so memory is
bounded by the sample and one record. Names are new for each attempt of a task; a table of archives, which is a
checkpoint, names those of the attempts that counted, so a lost executor leaves files that nothing reads.

Of pages with equal payloads of at least ``least`` bytes, that of the largest page_id is a response and the others are
revisits that refer to it; smaller payloads are all responses. Payloads are compared by sha256. Groups of copies are
summed before they meet the pages; those of over a ten-thousandth of all pages, at most 10,000, are broadcast, the rest
are broadcast where counted rows allow and else joined by shuffle, in which no key then has more rows than that.

Nulls and the like: a null html is an empty payload, a null url is an empty target. A null page_id counts as smaller
than any other; if all are null, all are responses and nothing is referred to. Rows that repeat the response's page_id
with its payload are responses too, so equal rows have equal results. An empty table gives no archives and no rows.
Further columns are left out.

``folder`` is a path or URI of a file system that pyarrow knows (shared mounts, HDFS, object stores).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BROADCAST_ROWS, checkpoint, join_small, shared_folder

#: Fixed values of the format: the skippable frame of a dictionary, and the profile of revisits of equal payloads.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Groups of copies of over this share of the pages are broadcast.
HOT_SHARE = 10_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id, digest: str) -> str:
    """The same for every record of a page and payload, so that revisits know the id of a record that another task writes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _field(value: str) -> str:
    """A URI on one line: white space, control characters and letters beyond ASCII are percent-encoded."""
    return urllib.parse.quote(value, safe="!#$%&'()*+,/:;=?@[]~")


def record(page_id, url: str, payload: bytes, kind: str, refers_to, date: str) -> bytes:
    """A WARC/1.1 record: the response with its payload, or a revisit with the response's HTTP header alone."""
    digest = payload_digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if kind == "response" else b""
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _field(url)), ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE)]
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record with its payload, block and payload digests checked; raises ValueError where it is damaged."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if lines[0] != "WARC/1.1" or not gap or rest[length:] != b"\r\n\r\n" or f"sha1:{payload_digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("damaged WARC payload")
    return {"page_id": fields["WARC-Page-ID"], "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": fields.get("WARC-Refers-To-Page-ID")}


def train(samples: list[bytes], size: int = 65_536) -> bytes:
    """A dictionary from records; the records' own bytes where they are too few to train on, nothing where there are none."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Writer:
    """Appends records to an open archive, each a frame; the dictionary is the leading skippable frame."""

    def __init__(self, out: BinaryIO, dictionary: bytes, level: int = 3) -> None:
        self.out, self.bytes, self.records = out, 0, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._frames = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self._frames.compress(data))
        self.records += 1


def frames(source: BinaryIO, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    dictionary = source.read(size)
    known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    left = source.read(piece)
    while left:
        frame, out = known.decompressobj(), []
        while True:
            out.append(frame.decompress(left))
            if frame.eof:
                left = frame.unused_data or source.read(piece)
                break
            left = source.read(piece)
            if not left:
                raise ValueError("archive ends inside a record")
        yield b"".join(out)


def classify(pages: DataFrame, least: int = 0, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, html, record_type, refers_to) of every row."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n"))
    copied = checkpoint(groups.where("n > 1 AND leader IS NOT NULL"))
    total = pages.count()
    hot = copied.where(F.col("n") > total / HOT_SHARE).select("digest", F.col("leader").alias("hot_leader"))
    cold = copied.where(F.col("n") <= total / HOT_SHARE).select("digest", "leader")
    # Rows that have met a hot group get keys that meet nothing and spread.
    spread = F.when(F.col("hot_leader").isNull(), F.col("digest")).otherwise(F.concat(F.lit(":"), F.col("page_id").cast("string")))
    small = join_small(rows.join(F.broadcast(hot), "digest", "left").withColumn("digest", spread), cold, ["digest"], "left", limit)
    leader = F.coalesce("hot_leader", "leader")
    revisit = leader.isNotNull() & ~F.col("page_id").eqNullSafe(leader)
    return small.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, leader).alias("refers_to"))


def write_archives(
    classified: DataFrame, folder: str, archive_bytes: int = 64 << 20, sample_bytes: int = 4 << 20, dictionary_bytes: int = 65_536, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Archives the rows of ``classify``; (path, records, bytes) of each archive, as a checkpoint."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        attempt, held, held_bytes, done = uuid.uuid4().hex, [], 0, []
        dictionary = writer = stream = None

        def close() -> None:
            stream.close()
            done.append((path, writer.records, writer.bytes))

        def put(data: bytes) -> None:
            nonlocal writer, stream, path, filled
            if writer is not None and filled + len(data) > archive_bytes:
                close()
                writer = None
            if writer is None:
                path, filled = f"{root}/{attempt}-{len(done):05d}.warc.zst", 0
                stream = files.open_output_stream(path, compression=None)
                writer = Writer(stream, dictionary)
            writer.add(data)
            filled += len(data)

        path, filled = "", 0

        def release() -> None:
            nonlocal dictionary, held
            dictionary = train(held, dictionary_bytes)
            for data in held:
                put(data)
            held = []

        for b in batches:
            for page_id, url, html, kind, refers_to in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                data = record(page_id, url, html.encode(), kind, refers_to, date)
                if dictionary is None:
                    held.append(data)
                    held_bytes += len(data)
                    if held_bytes > sample_bytes:
                        release()
                else:
                    put(data)
        if held:
            release()
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return checkpoint(classified.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str, page_id: str = "long") -> DataFrame:
    """Every record of the archives (path): page_id, url (percent-encoded), html (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = f"page_id {page_id}, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to {page_id}"
    kind = to_arrow_type(archives.sparkSession.createDataFrame([], f"k {page_id}").schema["k"].dataType)
    ids = int if pa.types.is_integer(kind) else str

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(folder)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [kind, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), kind]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in schema.split(", ")])

        for b in batches:
            for path in b.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as source:
                    for data in frames(source):
                        r = parse_record(data)
                        html = None if r["payload"] is None else r["payload"].decode()
                        rows.append((ids(r["page_id"]) if r["page_id"] else None, r["url"], html, r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else ids(r["refers_to"])))
                        held += len(data)
                        if len(rows) == 1000 or held > 8 << 20:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()

    return archives.select("path").mapInArrow(read, schema)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes a record of every page to archives in ``folder`` (one of the shared checkpoint folder unless given), and reads them back."""
    spark = pages.sparkSession
    if folder is None:
        base = shared_folder(spark)
        folder = f"{'file://' + base if base.startswith('/') else base}/warc-{uuid.uuid4().hex}"
    archives = write_archives(classify(pages, least), folder)
    return read_archives(archives, folder, pages.schema["page_id"].dataType.simpleString())


def archived_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as its archive has it."""
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS leader FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda g: cast(('0x' || substr(hex, 1 + 5 * g, 5)) AS bigint)) AS groups FROM d)
SELECT page_id, cast(strlen(html) AS bigint) AS payload_bytes,
  array_to_string(list_transform(groups, lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((g >> s) & 31 AS int), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM leader AND leader IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to FROM v"""
