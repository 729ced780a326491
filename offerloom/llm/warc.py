"""WARC archives: segmented records written by Spark's text writer, and reassembled when they are read.

A record's block is an HTTP response in chunked transfer framing. Blocks longer than `segment_bytes` become a response of
segment 1 and continuation records with the origin's identifier, rising segment numbers and, in the last, the total length.
The reader walks each file by Content-Length, groups segments by origin, orders them by number, checks the numbers and the
total length, and removes the chunked framing. Records with a payload that another record holds are revisits of it.
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

from .shared import new_folder, shared_table

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32: each 20 bits are five hexadecimal and four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if the framing is broken."""
    at, out = 0, []
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size
        if len(out[-1]) != size or body[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk is cut short")


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def _record(kind: str, identity: str, block: bytes, more: list[tuple[str, str | None]]) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identity}>"), *more, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block  # the two line ends after it come from the writer


def write_archives(pages: DataFrame, path: str, at_least: int = 0, segment_bytes: int = 16_384, chunk_bytes: int = 4096, records_per_file: int = 2048, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages (page_id, url, html) to gzip-compressed archives in the folder `path`.

    Of rows with equal payloads of at least `at_least` bytes, one of largest page_id (null smallest) is the response that
    the others revisit. A null html is an empty payload; a null url has no target. A repeated page is a record of its own
    (identifiers hold a row number too). A file has `records_per_file` records of about `segment_bytes` at most, which bounds
    what a reading task holds.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.monotonically_increasing_id().alias("uid"))
    rows = shared_table(rows, "numbered")  # so that both readers below see the same numbers, whatever the input is and whoever is lost
    rows = rows.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("identity", F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("uid").cast("string")))
    shares = F.octet_length("payload") >= at_least
    first = rows.where(shares).groupBy("digest").agg(F.max(F.struct(F.col("page_id"), "identity")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = shared_table(first.select(F.col("digest").alias("shared_digest"), F.col("first.identity").alias("first")), "responses")
    rows = rows.join(first, shares & (F.col("digest") == F.col("shared_digest")), "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for payload, url, digest, identity, first in zip(*[c.to_pylist() for c in batch.slice(at, 200).columns], strict=True):
                    target = None if url is None else re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
                    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
                    named = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                    if first is not None and first != identity:
                        out.append(_record("revisit", identity, HTTP + b"\r\n", [*common, *named, ("WARC-Refers-To", f"<{first}>"), ("WARC-Profile", PROFILE)]))
                        continue
                    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                    number = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
                    out.append(_record("response", identity, parts[0], [*common, *named, *number]))
                    for i, part in enumerate(parts[1:], 2):
                        origin = [("WARC-Segment-Origin-ID", f"<{identity}>"), ("WARC-Segment-Number", str(i))]
                        out.append(_record("continuation", f"{identity}:{i}", part, [*common, *origin, ("WARC-Segment-Total-Length", str(len(block)) if i == len(parts) else None)]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    text = rows.select("payload", "url", "digest", "identity", "first").mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of the records of an archive, gzip members or plain."""
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest))
            rest = member.unused_data
        content = b"".join(parts)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        yield head, content[end + 4 : end + 4 + size]
        at = end + 4 + size


def _facts(block: bytes) -> tuple[int, str]:
    payload = payload_of(block)
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(identity, record_type, refers_to, stated_digest, payload_bytes, payload_digest, complete) of the records in the folder.

    Segments are put together first; a record with a missing, repeated or surplus segment, a wrong total length or broken
    chunks is not complete and has no payload facts. Of a revisit, whose payload is elsewhere, only what it states is given.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "kind", "refers_to", "stated", "bytes", "digest", "number", "total", "block"]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                out = []
                for head, block in parse_records(batch.column(0)[i].as_buffer().to_pybytes()):
                    kind, whole = head["warc-type"], "warc-segment-number" not in head
                    size, digest = _facts(block) if whole and kind != "revisit" else (None, None)
                    number, total = (int(head[k]) if k in head else None for k in ("warc-segment-number", "warc-segment-total-length"))
                    stated = head.get("warc-payload-digest")
                    out.append((head.get("warc-segment-origin-id", head["warc-record-id"]).strip("<>"), kind, head.get("warc-refers-to", "").strip("<>") or None, stated and stated.partition(":")[2], size, digest, number, total, None if whole else block))
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(parse, "origin string, kind string, refers_to string, stated string, bytes long, digest string, number long, total long, block binary")
    heads = F.when(F.col("kind") != "continuation", F.struct("kind", "refers_to", "stated", "bytes", "digest"))
    segments = F.collect_list(F.when(F.col("block").isNotNull(), F.struct("number", "total", "block")))
    grouped = rows.groupBy("origin").agg(F.max(heads).alias("head"), segments.alias("segments"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                size, digest, good = part.column(4).to_pylist(), part.column(5).to_pylist(), []
                for i, segments in enumerate(part.column(6).to_pylist()):
                    good.append(part.column(1)[i].is_valid)
                    if segments:
                        segments.sort(key=lambda s: s["number"])
                        block = b"".join(s["block"] for s in segments)
                        good[i] = good[i] and [s["number"] for s in segments] == list(range(1, len(segments) + 1)) and segments[-1]["total"] == len(block)
                        try:
                            size[i], digest[i] = _facts(block) if good[i] else (None, None)
                        except ValueError:
                            good[i] = False
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(good)], ["identity", "record_type", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "complete"])

    flat = grouped.select("origin", "head.kind", "head.refers_to", "head.stated", "head.bytes", "head.digest", "segments")
    return flat.mapInArrow(assemble, "identity string, record_type string, refers_to string, stated_digest string, payload_bytes long, payload_digest string, complete boolean")


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write the pages, read them back, and give each page's payload facts; a revisit has those of the response it refers to."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    records = shared_table(read_archives(spark, path), "records")
    page = lambda c: F.nullif(F.split(c, ":")[2], F.lit("")).cast("bigint")
    held = records.where("record_type = 'response' and complete").select(F.col("identity").alias("held"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest"))
    rows = records.where("complete").join(held, F.col("refers_to") == F.col("held"), "left")
    return rows.select(
        page(F.col("identity")).alias("page_id"),
        F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "held_digest").alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )
