"""Operator 2: WARC archives in which equal payloads are stored once.

Headers only (id, address, length, SHA-1 of the payload) are grouped by digest; of equal payloads of
at least ``min_bytes`` the row with the largest page id is the response, and the others become
revisit records that point to it. Both sides of the join by digest are written tables, so that a
digest of very many pages is split. Records carry fresh headers; ids are addresses made of the page
id, so a rerun writes the same records. Every record is a gzip member of its own.

Cases: a null html is an empty payload, a null address an empty one. Null page ids lose against any
other and are written without a number. Rows that repeat the largest page id with the same payload
are responses as well, as nothing tells them apart. Header values are kept on one line. An empty
table writes no files. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.llm.common import open_store, staged, write_then_rename
from costdocs.sources.scratch import scratch_path

MIN_BYTES = 1000
ARCHIVE_BYTES = 256 << 20  # payload bytes after which a task begins a new archive
DATE = "2025-01-01T00:00:00Z"

# Record fields and the revisit profile of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"


def payload_headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest) of every row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def originals(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(payload_digest, payload_bytes, refers_to, target) of payloads that occur more than once."""
    key = F.struct(F.col("page_id").isNotNull(), F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    largest = groups.agg(F.max(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return largest.select("payload_digest", "payload_bytes", F.col("first.id").alias("refers_to"), F.col("first.url").alias("target"))


def resolved(pages: DataFrame, first: DataFrame) -> DataFrame:
    """Pages with digest, length and, for revisits, the page they refer to; their payload is dropped."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    joined = rows.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select(
        "page_id", "url", "payload_bytes", "payload_digest", revisit.alias("revisit"),
        F.when(revisit, F.col("refers_to")).alias("refers_to"), F.when(revisit, F.col("target")).alias("target"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _line(value: str | None) -> str:
    return " ".join((value or "").split())


def record(row: dict, date: str = DATE) -> bytes:
    """One record, with headers written anew."""
    kind = "revisit" if row["revisit"] else "response"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    number = "" if row["page_id"] is None else row["page_id"]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{RECORD_ID}{number}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _line(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
    ]
    if row["revisit"]:
        target = "" if row["refers_to"] is None else row["refers_to"]
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", f"<{RECORD_ID}{target}>"),
            ("WARC-Refers-To-Target-URI", _line(row["target"])),
            ("WARC-Refers-To-Date", date),
        ]
    else:
        body += row["payload"]
    fields += [
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(body).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"{VERSION}\r\n{head}\r\n".encode() + body + b"\r\n\r\n"


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes the records of every task to its own archives; one row (file, records) per archive.

    Files of a failed attempt stay unlisted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_store(path)
        part, files, out, size = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 128) for r in batch.slice(at, 128).to_pylist()):
                if out is None:
                    name, records, size = f"{part:08d}-{len(files):04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    context = write_then_rename(fs, f"{folder}/{name}")
                    out = context.__enter__()
                out.write(gzip.compress(record(row), level, mtime=0))
                records, size = records + 1, size + len(row["payload"] or b"")
                if size >= archive_bytes:
                    context.__exit__(None, None, None)
                    files.append((name, records))
                    out = None
        if out is not None:
            context.__exit__(None, None, None)
            files.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())], names=["file", "records"])

    return staged(rows.mapInArrow(write, "file string, records long"), "archives")


class _Members:
    """The bytes of an archive of gzip members, unpacked as they are read."""

    def __init__(self, file):
        self.file, self.unpack, self.ready, self.packed = file, None, b"", b""

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.file.read(1 << 20)
                if not self.packed:
                    return False
            if self.unpack is None or self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            new = self.unpack.decompress(self.packed)
            self.packed = self.unpack.unused_data if self.unpack.eof else b""
            if new:
                self.ready += new
                return True

    def line(self) -> bytes:
        at = self.ready.find(b"\r\n")
        while at < 0 and self._more():
            at = self.ready.find(b"\r\n")
        line, self.ready = self.ready[: max(at, 0)], self.ready[at + 2 if at >= 0 else len(self.ready) :]
        return line

    def take(self, count: int) -> bytes:
        parts, left = [], count
        while left:
            if not self.ready and not self._more():
                raise ValueError("an archive ends within a record")
            parts.append(self.ready[:left])
            self.ready = self.ready[left:]
            left -= len(parts[-1])
        return b"".join(parts)

    def at_end(self) -> bool:
        return not self.ready and not self._more()


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record."""
    members = _Members(file)
    while not members.at_end():
        if members.line().decode() != VERSION:
            raise ValueError("not a WARC record")
        fields = {}
        while line := members.line():
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = members.take(int(fields["Content-Length"]))
        members.take(4)
        yield fields, block


def _number(field: str) -> int | None:
    digits = field[len(RECORD_ID) + 1 : -1]
    return int(digits) if digits else None


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(spark: SparkSession, path: str, archives: DataFrame) -> DataFrame:
    """One row per record, from the archives; a response's payload must have its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_store(path)
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in _READ.split(", "))])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    for fields, block in read_records(file):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                        length = int(http.rpartition(b"Content-Length:")[2])
                        target = _number(fields["WARC-Refers-To"]) if revisit else None
                        rows.append((_number(fields["WARC-Record-ID"]), length, digest, fields["WARC-Type"], target, fields["WARC-Target-URI"]))
                        if len(rows) >= 20_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return archives.repartition(max(1, archives.count())).mapInArrow(read, _READ)


def deduplicated(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All pages written as archives without repeated payloads, and read back."""
    first = staged(originals(payload_headers(pages)), "originals")
    path = scratch_path(spark, "warc")
    return read_archives(spark, path, write_archives(resolved(pages, first), path))


ORACLE = """
SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest,
 CASE WHEN octet_length(encode(payload)) >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN octet_length(encode(payload)) >= 1000 AND page_id < newest THEN newest END AS refers_to, coalesce(url, '') AS url
FROM (SELECT page_id, url, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages)
"""
