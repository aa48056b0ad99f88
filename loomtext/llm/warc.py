"""WARC files: a sequential reader, and a writer for tables of pages (operator 8).

A file is read once, from its start, in pieces of a megabyte: each gzip member is one record, which
is decompressed as its bytes arrive; the header block ends at an empty line, Content-Length frames
the content, and two line ends close the record. WARC-Block-Digest (sha1, base32) is verified.
A task reads a file at a time and never holds more than one record and one batch of rows.

Result of `read`, one row for each record: path, offset and length of the gzip member, type,
record_id, target_uri, page_id, content_length, content, is_null (the page had no content at all),
digest_ok (null without a digest) and error.

Defined results: an empty file has no records; a member that is damaged, cut short, or whose record
does not keep to its Content-Length gives one row with what is known and an error, digest_ok is
false, and reading goes on at the next gzip signature. A header without a colon is ignored; of
repeated headers the last counts; a header block of more than HEAD_BYTES is an error, and so is a Content-Length, a page number or an encoded
address that is none. What is compressed is decompressed in pieces of PIECE, however small it was.

`write` makes one file for each partition of a table (id, url, content) in the shared folder, and
returns the paths; a retried task writes under a new name, and only the paths of finished tasks
count. Null ids and urls have no header, null contents a mark; rows may repeat; further columns are
ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.tables import materialized, shared_dir

SCHEMA = "path string, offset bigint, length bigint, type string, record_id string, target_uri string, page_id bigint, content_length bigint, content binary, is_null boolean, digest_ok boolean, error string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.string()]
PIECE = 1 << 20
BATCH_BYTES = 4 << 20
HEAD_BYTES = 16 << 20
_MAGIC = b"\x1f\x8b\x08"
_NUMBER = re.compile(r"-?[0-9]{1,18}", re.ASCII)


def digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, content: bytes | None, level: int = 6) -> bytes:
    """One resource record as one gzip member."""
    body = content or b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html", f"WARC-Block-Digest: {digest(body)}"]
    if url is not None:
        plain = url.isprintable() and url == url.strip()
        lines.append(f"WARC-Target-URI: {url}" if plain else f"X-Target-URI-Base64: {base64.b64encode(url.encode()).decode()}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if content is None:
        lines.append("X-Null-Content: true")
    lines.append(f"Content-Length: {len(body)}")
    c = zlib.compressobj(level, wbits=31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + c.compress(body) + c.compress(b"\r\n\r\n") + c.flush()


class Framing:
    """The parts of a record, from decompressed pieces in order."""

    def __init__(self) -> None:
        self.head, self.fields, self.size, self.parts, self.have, self.tail = bytearray(), None, -1, [], 0, b""
        self.bad: str | None = None
        self.sha = hashlib.sha1(usedforsecurity=False)

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            if self.bad:
                return
            begin = max(0, len(self.head) - 3)
            self.head += data
            end = self.head.find(b"\r\n\r\n", begin)
            if end < 0:
                if len(self.head) > HEAD_BYTES:
                    self.bad, self.head = "header without an end", bytearray()
                return
            data, lines = bytes(self.head[end + 4 :]), bytes(self.head[:end]).decode("utf-8", "replace").split("\r\n")
            self.head = bytearray()
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}
            self.version = lines[0]
            size = self.fields.get("content-length", "")
            self.size = int(size) if _NUMBER.fullmatch(size) and size[0] != "-" else -1
        take = data[: max(0, self.size - self.have)]
        self.sha.update(take)
        self.parts.append(take)
        self.have += len(take)
        self.tail += data[len(take) : len(take) + 64]

    def row(self, path: str, offset: int, length: int, error: str | None) -> tuple:
        f = self.fields or {}
        uri, page = f.get("warc-target-uri"), None
        bad = self.bad
        if "x-target-uri-base64" in f:
            try:
                uri = base64.b64decode(f["x-target-uri-base64"], validate=True).decode()
            except (binascii.Error, ValueError):
                bad = bad or "address that cannot be decoded"
        if "x-page-id" in f:
            if _NUMBER.fullmatch(f["x-page-id"]):
                page = int(f["x-page-id"])
            else:
                bad = bad or "page number that is none"
        if error is None:
            if bad and self.fields is None:
                error = bad
            elif self.fields is None or not self.version.startswith("WARC/"):
                error = "no WARC header"
            elif self.size < 0:
                error = "no Content-Length"
            elif self.have < self.size:
                error = f"content of {self.have} bytes instead of {self.size}"
            elif self.tail != b"\r\n\r\n":
                error = "record does not end behind its content"
            else:
                error = bad
        given = f.get("warc-block-digest")
        fits = None if given is None else given.lower() == "sha1:" + base64.b32encode(self.sha.digest()).decode().lower()
        null = "x-null-content" in f
        return (path, offset, length, f.get("warc-type"), f.get("warc-record-id"), uri, page, self.size if self.size >= 0 else None, None if null else b"".join(self.parts), null, False if error else fits, error)


def read_stream(stream, path: str) -> Iterator[tuple]:  # noqa: ANN001
    """The records of a file, in order: rows of SCHEMA. stream: has read(n)."""
    buf, base = b"", 0  # unread bytes, and their place in the file
    while True:
        if len(buf) < len(_MAGIC) and (more := stream.read(PIECE)):
            buf += more
            continue
        if not buf:
            return
        start, at, parts, error = base, Framing(), [], None
        z = zlib.decompressobj(wbits=31)
        while True:
            try:
                at.feed(z.decompress(buf, PIECE))
                while z.unconsumed_tail:
                    at.feed(z.decompress(z.unconsumed_tail, PIECE))
                while not z.eof and (more := z.decompress(b"", PIECE)):  # what zlib still holds
                    at.feed(more)
            except zlib.error as e:
                error = f"damaged: {e}"
                break
            if z.eof:
                base += len(buf) - len(z.unused_data)
                buf = z.unused_data
                break
            base += len(buf)
            buf = stream.read(PIECE)
            if not buf:
                error = "cut short"
                break
        if error and error.startswith("damaged"):
            buf, parts = buf[1:], [1]  # go on at the next signature behind this place
            base += 1
            while (k := buf.find(_MAGIC)) < 0:
                keep = buf[-2:]
                base += len(buf) - len(keep)
                more = stream.read(PIECE)
                if not more:
                    base += len(keep)
                    buf, k = b"", 0
                    break
                buf = keep + more
            buf, base = buf[k:], base + k
        yield at.row(path, start, base - start, error)


def write(pages: DataFrame, level: int = 4) -> DataFrame:
    """(path): the WARC files, one for each partition of `pages` (id, url, content, in that order)."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        empty = True
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in batches:
                for i in range(b.num_rows):
                    empty = False
                    out.write(record(b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), level))
        if not empty:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    a, b, c = pages.columns[:3]
    slim = pages.select(F.col(a).cast("bigint").alias("id"), F.col(b).cast("string").alias("url"), F.encode(F.col(c), "UTF-8").alias("content"))
    return materialized(slim.mapInArrow(run, "path string"), "warc-files")


def read(paths: DataFrame) -> DataFrame:
    """The records of all files of `paths` (path): see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], NAMES)

        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with where.open_input_stream(name, compression=None) as stream:
                    for r in read_stream(stream, path):
                        rows.append(r)
                        size += len(r[8] or b"") + 200
                        if size > BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, paths.count())
    return paths.select("path").repartition(n).mapInArrow(run, SCHEMA)
