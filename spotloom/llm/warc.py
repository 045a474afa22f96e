"""WARC archives: a writer that makes one gzip member of each record, and a sequential reader.

The reader inflates a member at a time with an incremental zlib decompressor, frames the record by its
Content-Length, verifies block and payload digests and goes on at the byte after the member. It inflates an archive in
slices, a record at a time, so that beside the compressed archive, which is one cell of at most 2 GB as Spark's
binaryFile source has it, its memory follows the largest record.

Records with equal payloads of at least `revisit_bytes` are written once, as the response of the smallest id; the
others are revisits that refer to it and have no payload of their own.

Defined cases: null html is an empty payload, null url leaves WARC-Target-URI out, a null id is written under a name
of its own and read back as null (such rows never serve as the response others refer to); ids of any text are escaped. Rows that repeat an id with equal
payloads are all responses if the id is the smallest. An empty table gives no archives. Other columns, also ones that differ
from the wanted only in case, do no harm. A damaged archive yields the
records before the damage and one row whose error says what is wrong.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm import frames

#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 8 << 20
#: Bytes given to the decompressor at a time.
SLICE = 1 << 16
#: Before ids in URIs; a null id has a name that no other has.
PAGE, NO_PAGE = "urn:page:", "urn:no-page"


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def uri(page_id: str | None) -> str:
    return NO_PAGE if page_id is None else PAGE + quote(page_id, safe="")


def page_of(said: str) -> str | None:
    """The id that a URI names; another archive's URIs are ids as they are."""
    said = said.strip("<>")
    return None if said == NO_PAGE else unquote(said.removeprefix(PAGE)) if said.startswith(PAGE) else said


def record(kind: str, page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{uri(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{uri(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + c.compress(block) + c.compress(b"\r\n\r\n") + c.flush()


class Broken(ValueError):
    """An archive that can't be read further."""


def members(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """Place and inflated bytes of each gzip member."""
    at = 0
    while at < len(data):
        start, inflate, parts = at, zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                raise Broken(f"the member at {start} is cut off")
            piece = data[at : at + SLICE]
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error as e:
                raise Broken(f"the member at {start}: {e}") from e
            at += len(piece) - len(inflate.unused_data)
        yield start, b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not first.startswith("WARC/"):
        raise Broken("no WARC header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken(f"not a field: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise Broken("no Content-Length") from e
    if n < 0 or rest[n:] != b"\r\n\r\n":
        raise Broken(f"Content-Length {n} does not frame a block of {len(rest)} bytes")
    block = rest[:n]
    if (said := fields.get("warc-block-digest")) and said.startswith("sha256:") and said != digest(block):
        raise Broken("the block's digest differs")
    return fields, block


def read_archive(data: bytes | memoryview) -> Iterator[dict]:
    """The records of an archive, the last with error set if it is damaged."""
    view, at = memoryview(data), 0
    try:
        for at, raw in members(view):
            fields, block = parse(raw)
            head, _, payload = block.partition(b"\r\n\r\n")
            length = next((int(x[15:]) for x in head.split(b"\r\n") if x[:15].lower() == b"content-length:" and x[15:].strip().isdigit()), len(payload))
            kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "")
            if kind == "response" and (len(payload) != length or said.startswith("sha256:") and digest(payload) != said):
                raise Broken("the payload's digest or length differs")
            own = lambda name: page_of(fields[name]) if name in fields else None  # noqa: E731, B023
            yield {
                "record_type": kind, "record_id": own("warc-record-id"), "refers_to": own("warc-refers-to"), "url": fields.get("warc-target-uri"),
                "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": said.removeprefix("sha256:"), "at": at, "error": None,
            }
    except Broken as e:
        yield dict.fromkeys(("record_type", "record_id", "refers_to", "url", "payload", "payload_bytes", "payload_digest")) | {"at": at, "error": str(e)}


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_bytes: int = 100) -> DataFrame:
    """page_id, url, html and refers_to: null for responses, else the id whose payload is equal.

    Pages are not shuffled where the digests that occur more than once are few enough to be broadcast (they are counted
    first). Where they are more, those of most pages are broadcast, and pages of the others, of which none has many, are
    joined by merge.
    """
    df = frames.pick(pages, page_id=id_col, url=url_col, html=html_col)
    df = df.withColumn("html", F.coalesce("html", F.lit("")))
    df = df.withColumn("k", F.when(F.octet_length("html") >= revisit_bytes, F.sha2(F.col("html").cast("binary"), 256)))
    first = df.where("k is not null").groupBy("k").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    scratch = frames.Scratch(df.sparkSession)
    first = scratch.keep(first.select(F.col("k").alias("k2"), "first", "n"), "first")
    few = first.count() <= frames.HOT_KEYS
    often = first if few else frames.hot_keys(first)
    joined = df.join(F.broadcast(often.select("k2", "first")), F.col("k") == F.col("k2"), "left").drop("k2")
    if not few:
        rest = first.join(F.broadcast(often.select("k2")), "k2", "left_anti").select("k2", F.col("first").alias("other"))
        # Pages that need no partner get keys of their own, which match nothing and spread over all tasks.
        own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
        joined = joined.withColumn("key", F.when(F.col("first").isNull() & F.col("k").isNotNull(), F.col("k")).otherwise(own))
        joined = joined.join(rest.hint("merge"), F.col("key") == F.col("k2"), "left").withColumn("first", F.coalesce("first", "other"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(planned: DataFrame) -> DataFrame:
    """Archives as rows (length, content) like those of the binaryFile source, of about ARCHIVE_BYTES each."""
    text = planned.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["length", "content"])
        for batch in batches:
            for page_id, url, html, refers in zip(*(c for c in batch.columns), strict=True):
                refers = refers.as_py()
                parts.append(record("revisit" if refers is not None else "response", page_id.as_py(), url.as_py(), html.as_py().encode(), refers))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()

    return text.mapInArrow(run, "length bigint, content binary")


_FIELDS = [("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("at", pa.int64()), ("error", pa.string())]


def read_archives(files: DataFrame, content_col: str = "content", payloads: bool = True) -> DataFrame:
    """A row for each record of each archive; files may come from spark.read.format("binaryFile").

    payloads=False leaves the payload column null, after it was verified.
    """
    df = frames.pick(files, content=content_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in read_archive(content.as_buffer()) if content.is_valid else ():
                    size += len(r["payload"] or b"")
                    rows.append(r if payloads else r | {"payload": None})
                    if len(rows) >= 1024 or size >= 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))

    return df.mapInArrow(run, "record_type string, record_id string, refers_to string, url string, payload binary, payload_bytes bigint, payload_digest string, at bigint, error string")
