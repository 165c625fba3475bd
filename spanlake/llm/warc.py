"""Operator 9: WARC archives, written with revisit records and read by byte ranges.

Every record is a gzip member of its own. A reader task is given a byte range of a file and owns the records
that start inside it: it looks for the gzip magic from the range's start, takes a candidate for a member only
if it decodes to a WARC header (the magic also occurs by chance in compressed data), and from there goes from
member to member until one starts at or after the range's end, reading past the end for its last record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import common

#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: First lines of records that are read: any version.
_VERSIONS = re.compile(rb"WARC/\d+\.\d+\r?\n")
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of one read, of a range of one reader task, and that a header fits in.
READ, RANGE, HEADER = 1 << 20, 8 << 20, 1 << 16
LEVEL = 6
_DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


_OWN = re.compile(r"<urn:page:(-?\d*)>")


def _page(uri: str | None) -> int | None:
    """The page id of a record id made here; of any other there is none."""
    own = _OWN.fullmatch(uri or "")
    return int(own[1]) if own and own[1] else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without payload if refers_to is given; its HTTP header tells the full length either way."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    data = VERSION + "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF * 2 + block + CRLF * 2
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """(page, first) of pages whose payload of at least min_bytes bytes a page of smaller id has too.

    Payloads are compared by SHA-256 and length; only ids and digests are shuffled, and the smallest id of a digest is
    combined before the shuffle. Pages with the smallest id itself are no revisits; null ids are never the smallest."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).cast("long").alias("page"), F.sha2(payload, 256).alias("d"), F.length(payload).alias("n")).filter(F.col("n") >= min_bytes).select("page", F.unhex(F.substring("d", 1, 32)).alias("d"))
    firsts = keyed.groupBy("d").agg(F.min("page").alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return keyed.join(firsts, "d").filter(F.col("page").isNull() | (F.col("page") != F.col("first"))).filter("first is not null").select("page", "first", "d")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row to gzip members in files under path; returns (file, bytes), a row per file.

    The payload is the text in UTF-8, null: empty. A file is one task's; names end in a number made from the task's
    partition, and an unfinished attempt never gets that name. An empty table may make no files."""
    spark = pages.sparkSession
    common.bound_batches(spark)
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), text.alias("html"), F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("d"))
    again = revisits(pages, id_col, payload_col, min_revisit_bytes).distinct()
    joined = rows.join(again.select(F.col("page").alias("p2"), F.col("d").alias("d2"), "first"), F.col("page").eqNullSafe(F.col("p2")) & (F.col("d") == F.col("d2")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        name, out, size = f"{root}/.attempt-{uuid.uuid4().hex}", None, 0
        for b in batches:
            for page, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html", "first"))):
                out = out or store.open_output_stream(name, buffer_size=READ)
                data = record(page, url, html.encode("utf-8", "surrogatepass"), first)
                out.write(data)
                size += len(data)
        if out:
            out.close()
            store.move(name, f"{root}/part-{part:05d}.warc.gz")
            yield pa.RecordBatch.from_pylist([{"file": f"part-{part:05d}.warc.gz", "bytes": size}])

    common.make_dir(spark, path)
    made = joined.select("page", "url", "html", "first").mapInArrow(run, "file string, bytes long").collect()  # a row a task
    return spark.createDataFrame(sorted(set(made)), "file string, bytes long")


class _Window:
    """Bytes of a file from an offset on, read in blocks and dropped as they are used."""

    def __init__(self, f: pa.NativeFile, at: int, size: int):
        self.f, self.base, self.buf, self.size = f, at, b"", size

    def need(self, at: int, n: int) -> bytes:
        """At most n bytes from offset at; fewer at the file's end."""
        if at > self.base:
            self.buf, self.base = self.buf[at - self.base :], at
        while len(self.buf) < n and self.base + len(self.buf) < self.size:
            self.buf += self.f.read_at(min(max(READ, n - len(self.buf)), self.size - self.base - len(self.buf)), self.base + len(self.buf))
        return self.buf[:n]


def _is_record(window: _Window, at: int) -> bool:
    """Whether a member starts at this offset whose data begins with a whole WARC header (or HEADER bytes of one)."""
    try:
        data = zlib.decompressobj(31).decompress(window.need(at, HEADER), HEADER)
    except zlib.error:
        return False
    head, end, _ = data.partition(CRLF * 2)
    return _VERSIONS.match(data) is not None and (len(data) == HEADER or bool(end) and b"\r\ncontent-length:" in head.lower())


def _member(window: _Window, at: int) -> tuple[bytes, int]:
    """The data of the member at an offset and where it ends."""
    z, parts = zlib.decompressobj(31), []
    while not z.eof:
        block = window.need(at, READ)
        if not block:
            raise ValueError("a record ends early")
        parts.append(z.decompress(block))
        at += len(block) - len(z.unused_data)
    return b"".join(parts), at


def scan_range(store: pafs.FileSystem, name: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the records that start in [start, end). A file with data and no record in its first range is refused."""
    with store.open_input_file(name) as f:
        size = f.size()
        window, at, end = _Window(f, start, size), start, min(end, size)
        while at < end:  # the first record
            block = window.need(at, READ)
            k = block.find(MAGIC)
            if k < 0 or at + k >= end:
                at += max(1, len(block) - len(MAGIC) + 1)
                if len(block) < READ or k >= 0:
                    at = end
                continue
            at += k
            if _is_record(window, at):
                break
            at += 1
        if start == 0 < size and at >= end:
            raise ValueError(f"{name}: no WARC record in the first {end} bytes")
        while at < end:
            data, after = _member(window, at)
            yield at, data
            at = after


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by their names in lower case; lines that are none are passed over."""
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}


def parse(data: bytes) -> dict:
    """Headers, HTTP headers (none if the block isn't HTTP) and payload of a record; names are in lower case."""
    head, _, rest = data.partition(CRLF * 2)
    headers = _fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a record ends early")
    if rest[size:].strip():
        raise ValueError("a member holds more than a record")
    block, http = rest[:size], {}
    if headers.get("content-type", "").startswith("application/http"):
        first, _, block = block.partition(CRLF * 2)
        http = _fields(first.decode("utf-8", "replace").split("\r\n")[1:])
    return {"headers": headers, "http": http, "payload": block}


def _row(r: dict) -> tuple:
    """page_id, record_id, url, record_type, payload_bytes, payload_digest, refers_to, refers_to_id, html, intact of a parsed record."""
    h, payload, ident = r["headers"], r["payload"], r["headers"].get("warc-record-id")
    kind, (method, _, told) = h.get("warc-type"), h.get("warc-payload-digest", "").partition(":")
    own, revisit = ident is not None and _OWN.fullmatch(ident) is not None, kind == "revisit"
    intact = None if revisit or method.lower() != "sha1" else digest(payload) == told
    length = len(payload)
    if own:
        length = int(r["http"]["content-length"])
        intact = intact is not False and (revisit or len(payload) == length)
    elif not told and not revisit:
        told = digest(payload)
    text = None if revisit else payload.decode("utf-8", "surrogatepass" if own else "replace")
    return _page(ident), ident, h.get("warc-target-uri"), kind, length, told or None, _page(h.get("warc-refers-to")), h.get("warc-refers-to"), text, intact


def read_warc(spark: SparkSession, path: str, files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """A row per record of any type: page_id, record_id, url, record_type, payload_bytes, payload_digest, refers_to,
    refers_to_id, html (null for revisits), intact, file, offset.

    page_id and refers_to are numbers only where write_warc made the record; ids of other writers are in record_id and
    refers_to_id. payload_bytes and payload_digest of what write_warc made are those its headers tell, and a payload that doesn't
    agree with them is an error. For other writers' records intact tells whether the payload has the SHA-1 in the
    header (null: none is told), and bytes that aren't UTF-8 are replaced in html. A file with data but no record in its
    first range, a record that ends early, and a member of several records (such files can't be split) are errors. No files:
    no rows."""
    spans = files.select("file", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("bytes") - 1), F.lit(range_bytes))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for span in b.to_pylist():
                rows, size = [], 0
                for at, data in scan_range(store, f"{root}/{span['file']}", span["start"], span["start"] + range_bytes):
                    r = parse(data)
                    row = _row(r)
                    if row[-1] is False and _OWN.fullmatch(row[1]):
                        raise ValueError(f"{span['file']} at {at}: the payload is damaged")
                    rows.append((*row, span["file"], at))
                    size += len(r["payload"])
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    tasks = max(1, spans.count())
    dealt = spans.repartition(min(tasks, 4 * common.shuffle_partitions(spark)), "file", "start")
    return dealt.mapInArrow(run, "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, html string, intact boolean, file string, offset long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64())
    names = ["page_id", "record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_to_id", "html", "intact", "file", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
