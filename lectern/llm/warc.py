"""WARC archives as a table of chunks.

Writing: each task streams its pages into one archive file of gzip members in the shared folder, a piece of a
payload at a time. Reading: each archive is parsed as a stream into rows (record_id, chunk_no, bytes), each with
the digest of the payload up to its end; no record is ever held whole beyond the row that it came from.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import join_checked, scratch_path, written

CHUNK = 1 << 18
#: Payloads below so many bytes are never deduplicated.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLANK = b"\r\n\r\n"
_RECORD = "record_id string, record_type string, page_id long, url string, refers_to long, payload_bytes long, declared_digest string, chunk_no long, bytes binary, digest string, last boolean"


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads of at least `least` bytes all but the largest page_id's
    refer to it. Rows that repeat that page_id are responses, too. Null html is an empty payload.
    """
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumn("_sha1", F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary"))))
    first = df.where("_sha1 is not null").groupBy("_sha1").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    df = join_checked(df, written(first, "payloads"), "_sha1")
    return df.select("page_id", "url", "html", F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("refers_to"))


def _head(page_id, url, kind: str, refers, digest: str, size: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + BLANK
    block = len(http) + (size if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + BLANK + http


def write(pages: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Write pages (page_id, url, html, refers_to) under folder; one row (path, records, bytes) an archive.

    A file's name holds a new identifier for each attempt, and only files whose rows were committed are listed, so
    retried tasks leave no double records. An empty task writes no file.
    """

    def run(batches):
        from pyarrow import fs

        out = path = None
        records = 0
        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                    store.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                html, refers = b.column(2)[i].as_buffer(), b.column(3)[i].as_py()
                digest = hashlib.sha1()
                for s in range(0, html.size, chunk):
                    digest.update(html.slice(s, min(chunk, html.size - s)))
                kind = "response" if refers is None else "revisit"
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(z.compress(_head(b.column(0)[i].as_py(), b.column(1)[i].as_py(), kind, refers, digest.hexdigest(), html.size)))
                if refers is None:
                    for s in range(0, html.size, chunk):
                        out.write(z.compress(html.slice(s, min(chunk, html.size - s))))
                out.write(z.compress(BLANK) + z.flush())
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")


class _Stream:
    """Bytes of all gzip members in turn, of an open file, some at a time."""

    def __init__(self, file, chunk: int) -> None:
        self.file, self.chunk, self.z, self.buffer, self.ended = file, chunk, zlib.decompressobj(47), b"", False

    def _more(self) -> bool:
        raw = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"") or self.file.read(self.chunk)
        if not raw:
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(47)
        self.buffer += self.z.decompress(raw, self.chunk)
        return True

    def take(self, n: int) -> bytes:
        """Up to n bytes; fewer only at the end."""
        while len(self.buffer) < n and self._more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without the mark; None at the end."""
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
    return {k.lower(): v for k, v in pairs}


def parse(file, chunk: int = CHUNK):
    """Chunk rows of an open archive, as tuples in the order of the table's columns."""
    page = lambda ref: int(x) if (x := ref.rsplit(":", 1)[-1].rstrip(">")).lstrip("-").isdigit() else None
    stream = _Stream(file, chunk)
    while (head := stream.until(BLANK)) is not None:
        f = _fields(head)
        http = stream.until(BLANK) or b""
        size, kind = int(_fields(http).get("content-length", 0)), f.get("warc-type", "")
        left = int(f["content-length"]) - len(http) - len(BLANK)
        digest, number = hashlib.sha1(), 0
        while True:
            piece = stream.take(min(chunk, left))
            if len(piece) < min(chunk, left):
                raise ValueError(f"archive ends inside {f.get('warc-record-id')}")
            left -= len(piece)
            digest.update(piece)
            refers = f.get("warc-refers-to")
            yield f.get("warc-record-id"), kind, page(f.get("warc-record-id", "")), f.get("warc-target-uri"), page(refers) if refers else None, size, f.get("warc-payload-digest", "").removeprefix("sha1:"), number, piece, digest.copy().hexdigest(), left == 0
            number += 1
            if left == 0:
                break
        if stream.take(4) != BLANK:
            raise ValueError(f"record {f.get('warc-record-id')} isn't closed")


def read(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of archives (path): record_id, record_type, page_id, url, refers_to, payload_bytes,
    declared_digest, chunk_no, bytes, digest (SHA-1 of the payload up to this chunk), last.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int64()), ("bytes", pa.binary()), ("digest", pa.string()), ("last", pa.bool_())])

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                with store.open_input_stream(path, compression=None) as file:
                    rows, size = [], 0
                    for row in parse(file, chunk):
                        rows.append(row)
                        size += len(row[8]) + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return archives.select("path").mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    archives = written(write(mark_revisits(pages), folder), "archives")
    files = archives.count()
    chunks = read(archives.repartition(max(1, files), "path"), folder)
    # a response's digest is that of what was read; a revisit holds no payload, only the digest of the one it refers to
    digest = F.when(F.col("record_type") == "response", F.col("digest")).otherwise(F.col("declared_digest"))
    return chunks.where("last").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
