"""WARC archives as a Spark data source: written and read by many tasks.

The writer gives one archive to each task, one gzip member to each record, with
the member's compressed length in an extra field of its header, so that a reader
can pass over a record without inflating it. Files are named by attempt and count
only once the driver's commit lists them in the folder's manifest, with the
offsets where the reader may split them.

The reader plans byte ranges of the listed files, takes record-type and header
predicates (filters on warc_type, page_id and target_uri), inflates and parses the
header of each record first, and inflates the payload only of records that pass, and
only if the payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import shared_dir

#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 1000
#: Compressed bytes of a reader's task, about.
SPLIT_BYTES = 16 << 20
MANIFEST = "manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    # Hadoop's names of stores that Arrow calls otherwise
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://")):
        path = ours + path.removeprefix(theirs) if path.startswith(theirs) else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(row) -> bytes:
    """One record, from a row (page_id, url, html, digest, payload_bytes, warc_type, refers_to)."""
    payload = (row["html"] or "").encode() if row["warc_type"] == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['warc_type']}",
        f"WARC-Record-ID: {record_uri(row['page_id'])}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode(),
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if row["warc_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(row['refers_to'])}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as a gzip member that tells its own length, if that fits in 32 bits; a reader inflates a longer one to its end."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    end = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(whole, len(data)) > 0xFFFFFFFF:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + end
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + end


class Inflater:
    """One gzip member of an open file: its header block, then its payload or not."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        file.seek(at)
        self.unzip = zlib.decompressobj(31)
        first = file.read(1 << 12)
        self.length = struct.unpack_from("<I", first, 16)[0] if first[3:4] == b"\x04" and first[12:14] == b"sl" else None
        self.read = len(first)
        self.pending = first
        self.data = b""

    def more(self) -> bool:
        if self.unzip.eof:
            return False
        if not self.pending:
            self.pending = self.file.read(1 << 16)
            self.read += len(self.pending)
            if not self.pending:
                raise EOFError("the archive ends within a record")
        # a little at a time, so that a header costs no payload
        self.data += self.unzip.decompress(self.pending, 1 << 11 if len(self.data) < 1 << 11 else 0)
        self.pending = self.unzip.unconsumed_tail if not self.unzip.eof else b""
        return True

    def header(self) -> dict[str, str]:
        while b"\r\n\r\n" not in self.data and self.more():
            pass
        block, _, self.data = self.data.partition(b"\r\n\r\n")
        return {k.lower(): v for k, _, v in (line.partition(": ") for line in block.decode().split("\r\n")[1:])}

    def payload(self, length: int) -> bytes:
        parts = [self.data]
        size = len(self.data)
        while size < length + 4 and not self.unzip.eof:
            self.data = b"\0" * (1 << 11)  # from here on whole reads are inflated
            self.more()
            parts.append(self.data[1 << 11 :])
            size += len(parts[-1])
        self.data = b"".join(parts)
        return self.data[:length]

    def end(self) -> int:
        """Where the next member begins; without a stated length the rest has to be inflated to learn it."""
        if self.length:
            return self.at + self.length
        while self.more():
            self.data = b""
        return self.at + self.read - len(self.unzip.unused_data)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    splits: list[int]
    size: int


class Writer(DataSourceWriter):
    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, iterator) -> Written:
        fs, base = _filesystem(self.path)
        name, out, at, splits = f"{uuid.uuid4().hex}.warc.gz", None, 0, [0]
        for row in iterator:
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            if at - splits[-1] >= SPLIT_BYTES:
                splits.append(at)
            data = member(record_bytes(row), self.level)
            out.write(data)
            at += len(data)
        if out is None:
            return Written(None, [], 0)
        out.close()
        return Written(name, splits, at)

    def commit(self, messages) -> None:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        files = sorted(((m.name, m.splits, m.size) for m in messages if m and m.name), key=lambda f: f[0])
        with fs.open_output_stream(f"{base}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Files of no manifest are never read."""


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.with_payload = path, payload
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("warc_type", "page_id", "target_uri"):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, base = _filesystem(self.path)
        with fs.open_input_stream(f"{base}/{MANIFEST}", compression=None) as file:
            files = json.loads(file.read())
        return [Range(name, a, b) for name, splits, size in files for a, b in zip(splits, [*splits[1:], size], strict=True)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.start >= partition.end:
            return
        fs, base = _filesystem(self.path)
        with fs.open_input_file(f"{base}/{partition.name}") as file:
            at = partition.start
            while at < partition.end:
                record = Inflater(file, at)
                head = record.header()
                kind, page, uri = head["warc-type"], _page(head["warc-record-id"]), head.get("warc-target-uri")
                uri = uri if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                if all(v in self.wanted[c] for c, v in (("warc_type", kind), ("page_id", page), ("target_uri", uri)) if c in self.wanted):
                    payload = record.payload(int(head["content-length"])) if self.with_payload and kind == "response" else None
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of record {head['warc-record-id']} doesn't have its digest")
                    yield page, uri, kind, int(head["x-payload-length"]), digest, _page(head.get("warc-refers-to")), payload
                at = record.end()


def _page(uri: str | None) -> int | None:
    found = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


class WarcSource(DataSource):
    """Format ``warc``; options: path, payload (true: the payload column is filled), level (of compression)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "page_id long, target_uri string, warc_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("level", "6")))


def typed(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, payload_bytes, warc_type, refers_to) of every row.

    A null html is the empty payload. Of equal payloads of at least ``least`` bytes
    the record with the largest page_id is the response, and a null page_id is
    below all others; rows that share the largest page_id are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "payload_bytes": F.octet_length("html").cast("long")})
    copied = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    copied = copied.select("digest", "last", F.lit(least).alias("least"))
    joined = rows.join(copied, "digest", "left")
    again = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", "digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("warc_type"), F.when(again, F.col("last")).alias("refers_to"))


def archive(pages: DataFrame, path: str | None = None, level: int = 6) -> str:
    """Write a record for every row of ``pages`` to archives in a new folder; returns its path. An empty table gives a folder of no records."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    typed(pages).write.format("warc").option("path", path).option("level", str(level)).mode("append").save()
    return path


def read(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in a folder; filters on warc_type, page_id and target_uri reach the reader.

    Turns on the session's ``spark.sql.python.filterPushdown.enabled``, which the filters need when the plan is made.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
