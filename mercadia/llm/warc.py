"""WARC archives of pages, and a reader that salvages what damaged archives still hold (operator 6).

Writing: each page becomes one record. Of the pages with equal payloads the one with the smallest page_id is a response; the
others are revisits that name it and carry no payload. Records are built by DataFrame functions and written by Spark's
own text writer, whose separator is the two line ends that close a WARC record; so commits, retries and remote stores
are Spark's affair. One file is an archive of whole records.

Finding equal payloads takes a shuffle of digests only, pre-aggregated, so a crowd of equal pages meets as one row for each task. The
digests that repeat, and the revisits, go back by broadcast if their counted rows are within a limit; beyond it they are salted, so that a
crowd is spread over SALTS tasks. An archive holds ARCHIVE_BYTES on average and never more than Spark's binary reader takes.

Reading: archives come in whole, through Spark's binary reader, so a file may have 2 GB at most. Each record must start with a
version line, have a header of at most HEAD_BYTES and a length that ends where the next record or the file ends, and fit its block digest, or its payload digest where it
has no block digest and its payload isn't chunked. Digests of other algorithms than SHA-1 are not checked, and an HTTP length
that differs from the payload's is no damage. Where a check fails, the reader looks for the next valid record (the nearer of the
next version line and the next gzip member, over the whole file), goes on there, and reports the bytes between as quarantined. A file
may hold plain records and gzip members, in any mixture; a member may hold several records and gaps between them. Of a member that is damaged
or cut, what decompresses before the damage is read for records, which pass their own checks, and the rest is a gap, as is a checksum
that doesn't fit; the next record is looked for from the member's start on, since a cut may lie anywhere in it. Headers take linear time, however many
version lines lead to none.

Defined results: null html counts as an empty payload, which like any other can be revisited. Repeated rows of the
smallest page_id are all responses. A null page_id comes last in the choice of the response. URLs are percent-encoded
where they hold control characters or spaces; a null url leaves the header out. Other columns of pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import broadcast_if, fresh_path, salted_join, spool, table

END = "\r\n"
GAP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BROADCAST = 200_000
SALTS = 32
ARCHIVE_BYTES, MOST_BYTES = 256 << 20, (1 << 31) - (1 << 20)
READ_SCHEMA = "file string, at long, bytes long, inner long, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_VERSION_END = (b"WARC/1.0", b"WARC/1.1")
#: A record's header has this many bytes at most.
HEAD_BYTES = 1 << 20
#: A gzip member is opened in steps of this many bytes, a step that fails in smaller ones.
_STEPS = (1 << 16, 256, 1)


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32: 20 bits at a time, from hex to digits of base 32, to its letters."""
    digest = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_payload(pages: DataFrame) -> DataFrame:
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return slim.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("length", F.octet_length("html").cast("long"))


def revisits(payloads: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that are no response."""
    digests = spool(payloads.select("page_id", "digest"), "digests")
    first = spool(digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    return salted_join(digests, first, first.count(), REVISIT_BROADCAST, ["digest"], F.col("page_id"), SALTS).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def _urn(page: Column) -> Column:
    """A record id made from the page's number."""
    h = F.md5(page.cast("string").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One record for each page, in as many archives as the input has partitions, or more where those would be too large."""
    payloads = with_payload(pages)
    seen = payloads.agg(F.avg("length").alias("mean"), F.max("length").alias("most"), F.max(F.coalesce(F.octet_length("url"), F.lit(0))).alias("url")).first()
    head = 2048 + 3 * (seen["url"] or 0)
    rows = max(1, min(int(ARCHIVE_BYTES / (head + (seen["mean"] or 0))), MOST_BYTES // (head + (seen["most"] or 0))))
    again = spool(revisits(payloads), "revisits")
    known = broadcast_if(again.withColumnsRenamed({"page_id": "_p", "digest": "_d"}), again.count(), REVISIT_BROADCAST)
    joined = payloads.join(known, payloads["page_id"].eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left").withColumn("again", F.col("_d").isNotNull())
    url = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""), " ", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("length").cast("string"), F.lit(GAP))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, "html"))
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), _urn(F.col("digest")))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block").cast("binary")))),
        _line("WARC-Profile", F.when(F.col("again"), REVISIT)),
        _line("WARC-Refers-To", F.when(F.col("again"), _urn(F.col("refers_to")))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Refers-To-Page", F.when(F.col("again"), F.col("refers_to"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("block")),
        F.lit(END),
        F.col("block"),
    )
    joined.withColumn("block", block).select(record.alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", rows).text(path)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _stated(digest: str | None) -> str | None:
    """A SHA-1 of a header in upper-case base32, whether given so or in hex; None for other algorithms or none."""
    name, _, value = (digest or "").partition(":")
    if name.lower() != "sha1" or not value:
        return None
    return base64.b32encode(bytes.fromhex(value)).decode() if re.fullmatch(r"[0-9A-Fa-f]{40}", value) else value.upper()


def _header(data: bytes, at: int) -> tuple[dict[str, str] | None, int]:
    """The fields of the header at `at` and where it ends. It is read line by line and given up at the first line that can't be a field, a further version line among them."""
    fields, start = {}, data.index(b"\r\n", at) + 2
    while start - at <= HEAD_BYTES:
        end = data.find(b"\r\n", start, at + HEAD_BYTES)
        if end == start:
            return fields, end + 2
        line = data[start:end] if end > 0 else b""
        name, found, value = line.partition(b":")
        if not found or line.endswith(_VERSION_END):
            break
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        start = end + 2
    return None, at


def _record(data: bytes, at: int) -> tuple[dict | None, int]:
    """The record at `at` and where it ends; None if any check fails."""
    if not _VERSION.match(data, at):
        return None, at
    fields, first = _header(data, at)
    if fields is None or not re.fullmatch("[0-9]{1,18}", length := fields.get("content-length", "")):
        return None, at
    end = first + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at
    block = data[first:end]
    if (stated := _stated(fields.get("warc-block-digest"))) and stated != _sha1(block):
        return None, at
    kind, payload, http = fields.get("warc-type", ""), block, b""
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    full, digest = len(payload), _stated(fields.get("warc-payload-digest"))
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", http)
        full = int(size[1]) if size else full
    else:
        own = _sha1(payload)
        if not stated and digest and digest != own and not re.search(rb"(?im)^transfer-encoding:", http):
            return None, at
        digest = own
    number = lambda x: int(x) if x and re.fullmatch(r"-?[0-9]{1,18}", x) else None
    return {
        "kind": kind, "page_id": number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "payload_bytes": full,
        "payload_digest": digest, "refers_to": number(fields.get("x-refers-to-page")), "payload": payload if kind == "response" else None,
    }, end + 4


def _deflated(data: bytes, at: int) -> int:
    """Where the compressed data of the gzip member at `at` begin, behind its header; -1 if that is no header."""
    flags, start = (data[at + 3] if at + 3 < len(data) else 0xFF), at + 10
    if flags & 0xE0:
        return -1
    if flags & 4:
        start += 2 + int.from_bytes(data[start : start + 2], "little")
    for _ in range(bool(flags & 8) + bool(flags & 16)):  # name and comment
        start = data.find(b"\0", start, start + HEAD_BYTES) + 1 or len(data)
    return start + 2 * bool(flags & 2)


def _member(data: bytes, at: int) -> tuple[list[tuple[dict | None, int, int]], int, bool]:
    """What decompresses of the gzip member at `at`, as `_plain` gives it, where that ends (at the member's end, at the damage, or before a checksum that doesn't fit), and whether the member is whole. A whole member without records counts as read."""
    end, opened, body = _deflated(data, at), zlib.decompressobj(-15), []
    if end < 0:
        return [], at, False
    view, step = memoryview(data), 0
    while not opened.eof and end < len(data):
        before = opened.copy() if step < len(_STEPS) - 1 else None
        fed = view[end : end + _STEPS[step]]
        try:
            body.append(opened.decompress(fed))
            end += len(fed)
        except zlib.error:
            if before is None:
                break
            opened, step = before, step + 1
    text = b"".join(body)
    found = list(_plain(text))
    good = any(x[0] for x in found)
    if opened.eof:
        end -= len(opened.unused_data)
        if data[end : end + 8] == (zlib.crc32(text) | (len(text) & 0xFFFFFFFF) << 32).to_bytes(8, "little"):
            return found if good else [], end + 8, True
    return (found, end, False) if good else ([], at, False)


def _plain(data: bytes) -> Iterator[tuple[dict | None, int, int]]:
    """Every valid record of plain data and every gap as None, each with where it starts and ends."""
    at = bad = 0
    while at < len(data):
        record, end = _record(data, at)
        if record is None:
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad < at:
            yield None, bad, at
        yield record, at, end
        at = bad = end
    if bad < at:
        yield None, bad, at


def salvage(data: bytes) -> Iterator[tuple[dict | None, int, int, tuple[int, int] | None]]:
    """Every record that passes its checks, and every gap between them as None, each with where it starts and ends, in file order.
    What comes out of a gzip member has the member's place, and its own within the opened member last."""
    at = bad = 0
    open_end: list[tuple[dict | None, int, int]] = []  # what a damaged member gave, which ends at `bad` or, if that is earlier, where the next record starts
    start = 0

    def close(until: int) -> Iterator[tuple[dict | None, int, int, tuple[int, int] | None]]:
        nonlocal bad
        if open_end:
            bad = min(bad, until)
            yield from ((record, start, bad, (a, b)) for record, a, b in open_end)
            open_end.clear()
        if bad < until:
            yield None, bad, until, None

    while at < len(data):
        if data.startswith(_MEMBER, at):
            inside, end, whole = _member(data, at)
            found = [(record, at, end, (a, b)) for record, a, b in inside]
        else:
            record, end = _record(data, at)
            inside, whole = [], True
            found = [(record, at, end, None)] if record else []
        if found:
            yield from close(at)
            bad = end
            if not whole:
                open_end, start = inside, at
            else:
                yield from found
        if found and whole:
            at = end
        else:
            m = _START.search(data, max(at + 1, end if whole else 0))
            at = m.start() if m else len(data)
    yield from close(len(data))


def read_archives(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """READ_SCHEMA: one row for each record, and one of kind `quarantined` for each gap, of the files whose names fit the glob. Archives that other tools wrote may be gzipped.

    at and bytes are the place in the file; for what a gzip member holds, at is the member's, and inner and bytes are the place in the opened member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("inner", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for record, at, end, inner in salvage(content.as_py()):
                    size = end - at if inner is None else inner[1] - inner[0]
                    rows.append({"file": name.as_py(), "at": at, "bytes": size, "inner": inner and inner[0]} | (record or {"kind": "quarantined"}))
                    held += size
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


_DIGITS = " || ".join(f"to_base(('0x' || substr(sha1(coalesce(html, '')), {5 * k + 1}, 5))::BIGINT, 32, 4)" for k in range(8))
ORACLE = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         translate({_DIGITS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM pages
), m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""
