"""WARC archives: written with revisits in place of repeated payloads, read back in splits.

Each record is a gzip member of its own. Spark's text writer lays the members
down (it writes the bytes of a row as they are, and commits files only when a
task has ended), with an empty gzip member as its line end, so that a file is
a valid multi-member gzip whatever its name.

A reading task owns a range of bytes. It looks for the gzip magic number,
takes a place for the start of a record if what follows decodes to a WARC
header, and reads every record that starts inside its range to the end, also
beyond the range; what started earlier belongs to the task before.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.common import map_batches
from ratingloom.session import write_shared

# Magic number of a deflate member, the empty member, and names of the format.
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    """Payloads of ``min_bytes`` or more that are equal become revisits. ``split`` is the size of the
    ranges that reading tasks own, ``chunk`` how much they read at once. ``level`` is that of gzip.
    """

    min_bytes: int = 1000
    split: int = 16 << 20
    chunk: int = 1 << 18
    level: int = 5
    date: str = "2020-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def with_roles(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """``pages`` (page_id, url, html) with the payload, its digest, and what a revisit refers to.

    Payloads are equal if their SHA-1 and length are. Only payloads that occur
    twice or more are joined back, as one row each.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.length("payload").cast("long")})
    # the narrow table is written, so that payloads are hashed for it alone and never shuffled with it
    keys = rows.where(F.col("n_bytes") >= params.min_bytes).select("page_id", "digest", "n_bytes")
    groups = keys.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    repeated = write_shared(groups.where("n > 1").select("digest", "n_bytes", "response"), "repeated")
    joined = rows.join(repeated, ["digest", "n_bytes"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("response")).alias("refers_to"))


def _member(page_id, url, payload: bytes, digest: str, refers_to, params: WarcParams) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, which has the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    # a URI may not hold spaces, line ends or characters outside ASCII
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", params.date),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v)
    packer = zlib.compressobj(params.level, zlib.DEFLATED, 31)
    whole = b"%b\r\n%b\r\n%b\r\n\r\n" % (VERSION, head.encode(), block)
    return packer.compress(whole) + packer.flush()


def write_archive(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to files under ``path``.

    A null html is an empty payload. Of equal payloads the one with the
    largest page_id is the response. Files are renamed to end in .warc.gz.
    """

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            members.append(_member(*row, params))
            size += len(members[-1])
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])
                members, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    members = map_batches(with_roles(pages, params), pack, "member binary")
    # a cast to string keeps the bytes as they are
    lines = members.select(F.col("member").cast("string").alias("value"))
    writer = lines.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.option("compression", "none").text(path)
    spark = pages.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        place = status.getPath()
        if place.getName().endswith(".txt"):
            files.rename(place, place.getParent().suffix("/" + place.getName()[: -len("txt")] + "warc.gz"))


def _open(uri: str):
    """File and its size, from any file system that pyarrow knows by the URI (file, s3, gs, hdfs)."""
    if urlsplit(uri).scheme in ("", "file"):
        system, path = fs.LocalFileSystem(), unquote(urlsplit(uri).path)
    else:
        system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class _Window:
    """The bytes of a file from a moving place on, read chunk by chunk."""

    def __init__(self, file, at: int, chunk: int):
        self.file, self.base, self.data, self.chunk = file, at, b"", chunk
        self.ended = False

    def more(self) -> bool:
        self.file.seek(self.base + len(self.data))
        read = self.file.read(self.chunk)
        self.data += read
        self.ended = len(read) < self.chunk
        return bool(read)

    def drop(self, at: int) -> None:
        """Forget what lies before the place."""
        if at > self.base:
            self.data, self.base = self.data[at - self.base :], at

    def find(self, at: int, end: int) -> int:
        """First place of the magic number in [at, end), or -1."""
        self.drop(at)
        while True:
            place = self.data.find(MAGIC)
            if place >= 0:
                return self.base + place if self.base + place < end else -1
            keep = self.base + max(0, len(self.data) - len(MAGIC) + 1)
            if keep >= end or not (self.drop(keep) or self.more()):
                return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """Content of the gzip member at the place and where it ends; None if it isn't one of WARC."""
        self.drop(at)
        unpacker, parts, used, size, fine = zlib.decompressobj(31), [], 0, 0, False
        while not unpacker.eof:
            if used == len(self.data) and not self.more():
                return None
            piece = self.data[used : used + self.chunk]
            try:
                out = unpacker.decompress(piece)
            except zlib.error:
                return None
            used += len(piece)
            parts.append(out)
            size += len(out)
            if not fine:
                start = b"".join(parts)[: len(VERSION)]
                if start != VERSION[: len(start)]:
                    return None
                fine = len(start) == len(VERSION)
        return (b"".join(parts), at + used - len(unpacker.unused_data)) if fine else None


def parse_record(content: bytes) -> dict | None:
    """Fields of a record, the HTTP header's length of payload, and the payload; None if malformed."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in lines[1:]) if c}
    if not gap or not fields.get("content-length", "").isdigit():
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"\r\ncontent-length:\s*(\d+)", http, re.IGNORECASE)
    return {"fields": fields, "stated": int(stated[1]) if stated else None, "payload": payload}


def records(file, start: int, end: int, chunk: int) -> Iterator[dict]:
    """Records of an open file that start in [start, end)."""
    window, at = _Window(file, start, chunk), start
    while (at := window.find(at, end)) >= 0:
        found = window.member(at)
        if found is None:  # part of a record's data, an empty member, or damaged
            at += 1
            continue
        record = parse_record(found[0])
        at = found[1]
        if record is not None:
            yield record


_READ = (
    "record_id string, record_type string, target_uri string, payload_digest string, "
    "refers_to string, stated_bytes long, payload binary"
)


def read_archive(spark: SparkSession, path: str, params: WarcParams = WarcParams()) -> DataFrame:
    """All records under ``path``: ids, type, URI, digest (hex SHA-1), stated length and payload.

    Executors must reach the path by its URI. The payload of a revisit is
    empty; its HTTP header still states the length.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # path and length only: the content of the files is not read here
    files = listed.where(F.col("length") > 0).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(params.split))).alias("start")
    ranges = files.select("path", starts)
    n = max(1, files.agg(F.sum(F.ceil(F.col("length") / params.split))).first()[0] or 0)
    ranges = ranges.repartition(int(n), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(path) as file:
                    rows, size = [], 0
                    for record in records(file, start, start + params.split, params.chunk):
                        rows.append(record)
                        size += len(record["payload"])
                        if size > 1 << 23:
                            yield _record_rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _record_rows(rows)

    return ranges.mapInArrow(read, _READ)


def _record_rows(rows: list[dict]) -> pa.RecordBatch:
    def field(name: str) -> pa.Array:
        return pa.array([r["fields"].get(name) for r in rows], pa.string())

    digests = []
    for r in rows:
        kind, _, value = r["fields"].get("warc-payload-digest", "").partition(":")
        digests.append(base64.b32decode(value).hex() if kind == "sha1" and value else None)
    return pa.RecordBatch.from_arrays(
        [
            field("warc-record-id"),
            field("warc-type"),
            field("warc-target-uri"),
            pa.array(digests, pa.string()),
            field("warc-refers-to"),
            pa.array([r["stated"] for r in rows], pa.int64()),
            pa.array([r["payload"] for r in rows], pa.binary()),
        ],
        ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "stated_bytes", "payload"],
    )


def page_digests(archive: DataFrame) -> DataFrame:
    """Records of :func:`read_archive` as (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Length and digest of a response are taken from the payload that was read,
    those of a revisit from its headers. ``intact`` tells whether a payload
    has the digest that its header states.
    """

    def page(name: str) -> F.Column:
        return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    response = F.col("record_type") == "response"
    own = F.sha1("payload")
    return archive.select(
        page("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, own).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        F.when(response, own == F.col("payload_digest")).alias("intact"),
    )
