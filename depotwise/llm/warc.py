"""WARC archives: writing with segments, chunked framing and revisits, and reading them back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotwise.session import work_path

VERSION = b"WARC/1.1\r\n"
# Where the next record starts, after the line ends between two. Files are split into records here. The
# mark has no beginning inside itself, so a reader that meets half of it needn't look back.
BOUNDARY = b"\n" + VERSION
SEGMENT_BYTES = 32 << 10  # longer blocks continue in further records
CHUNK_BYTES = 8 << 10
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk ends inside any version that the payload contains: line ends of the
    framing, or of records, on either side would make a boundary of it, and no block of an archive may
    contain one."""
    version = VERSION.rstrip()
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        found = payload.find(version, at, min(end + len(version) - 1, len(payload)))
        if found >= 0:
            end = min(end, found + len(version) // 2)
        out.append(b"%x\r\n%s\r\n" % (end - at, payload[at:end]))
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        chunk = body[line + 2 : line + 2 + size]
        if len(chunk) < size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            return None
        out.append(chunk)
        at = line + 4 + size
    return None


def header(fields: dict[str, object]) -> bytes:
    clean = ((k, re.sub(r"[\r\n]+", " ", str(v))) for k, v in fields.items() if v is not None)
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in clean) + b"\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, first: int | None, is_first: bool, segment: int) -> list[bytes]:
    """The records of a page, each without the version line in front and the boundary behind."""
    identity = f"<urn:uuid:{uuid.uuid4()}>"
    fields = {"WARC-Type": "response", "WARC-Record-ID": identity, "WARC-Date": DATE, "WARC-Target-URI": url, "Page-ID": page_id}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http;msgtype=response"}
    if not is_first:
        head = b"HTTP/1.1 200 OK\r\n" + header({"Content-Length": len(payload)})
        revisit = {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [header(fields | revisit | {"Refers-To-Page-ID": first, "Content-Length": len(head)}) + head]
    block = b"HTTP/1.1 200 OK\r\n" + header({"Content-Type": "text/html; charset=utf-8", "Transfer-Encoding": "chunked"}) + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(parts) == 1:
        return [header(fields | {"Content-Length": len(block)}) + block]
    out = [header(fields | {"WARC-Segment-Number": 1, "Content-Length": len(parts[0])}) + parts[0]]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": identity}
        total = len(block) if n == len(parts) else None
        out.append(header(more | {"WARC-Segment-Number": n, "WARC-Segment-Total-Length": total, "Content-Length": len(part)}) + part)
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Gzipped archives of `pages` (page_id, url, html) below `path`, written by Spark.

    Of pages with equal payloads (null html: the empty payload) the one with the largest page_id is a
    response (a null id counts as smallest, and rows that repeat the largest id are responses as well);
    the others are revisits that name it. Roles come from a maximum per digest, summed before the
    exchange, and a join on the digest that Spark can split, so a payload of many pages is no hot spot."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "is_first")), strict=True):
                out += [VERSION + r for r in records(*row, segment)]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    sha = F.sha1("payload").alias("sha")
    firsts = rows.select("page_id", sha).groupBy("sha").agg(F.max("page_id").alias("first"))
    roles = rows.withColumn("sha", sha).join(firsts, "sha").withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first")))
    lines = roles.select("page_id", "url", "payload", "first", "is_first").mapInArrow(write, "value binary")
    # the text writer puts the bytes down as they are; every record ends with two line ends
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


READ = (
    "origin string, segment bigint, total bigint, kind string, page_id bigint, url string, digest string, refers_to bigint, "
    "complete boolean, block binary"
)
NAMES = [part.split()[0] for part in READ.split(", ")]


def parse(raw: bytes) -> tuple | None:
    """A record's fields and block. None for what stands between records."""
    raw = raw.removeprefix(VERSION)
    head, mark, block = raw.partition(b"\r\n\r\n")
    if not mark:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if colon:
            fields[key.strip().lower()] = value.strip()
    if "warc-type" not in fields:
        return None
    number = lambda name: int(v) if re.fullmatch(r"-?\d+", v := fields.get(name, "")) else None
    length = number("content-length")
    whole = length is not None and len(block) >= length and not block[length:].strip(b"\r\n")
    kind = fields["warc-type"]
    origin = fields.get("warc-segment-origin-id") if kind == "continuation" else fields.get("warc-record-id")
    return (
        origin, number("warc-segment-number"), number("warc-segment-total-length"), kind, number("page-id"), fields.get("warc-target-uri"),
        fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, number("refers-to-page-id"), whole, block[:length],
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below `path`, one row each; `complete` tells whether the block is as
    long as its header says. Files are read by Spark's text source with the boundary between records as
    its separator, so that no file has to fit in memory."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for raw in batch.column("value").to_pylist() if (row := parse(raw)) is not None]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    lines = spark.read.option("lineSep", BOUNDARY.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(split, READ)


def reassembled(found: DataFrame) -> DataFrame:
    """Records with their continuations joined: rows of `read_records` without continuations.

    Continuations are grouped by the record they continue and ordered by segment number. `complete`
    holds only if the numbers run from 1 without gaps, every part is complete, and the length is that of
    the last segment's total. Only segmented records are exchanged, and a group is one record's parts. A
    continuation whose origin is missing gives an incomplete row of kind `continuation`."""
    single = found.where("segment is null")
    # a segment that was read twice counts once
    parts = found.where("segment is not null").dropDuplicates(["origin", "segment"])
    head = F.struct("segment", "kind", "page_id", "url", "digest", "refers_to")
    joined = parts.groupBy("origin").agg(
        F.min(head).alias("head"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("segment").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.min("complete").alias("whole"),
    )
    block = F.expr("aggregate(parts, cast('' as binary), (b, p) -> b || p.block)")
    numbers = (F.col("head.segment") == 1) & (F.col("last") == F.col("n"))
    joined = joined.withColumn("block", block).select(
        "origin", F.col("head.segment").alias("segment"), "total", "head.kind", "head.page_id", "head.url", "head.digest", "head.refers_to",
        (F.col("whole") & numbers & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))).alias("complete"), "block",
    )
    return single.unionByName(joined)


PAGES = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, valid boolean, payload binary"


def payloads(rows: DataFrame) -> DataFrame:
    """What `reassembled` rows carry: payload and its length and digest, which are those of the record
    named for a revisit. `valid`: complete, well framed, and of the digest that the header names."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                head, _, body = row["block"].partition(b"\r\n\r\n")
                length = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
                if row["kind"] == "revisit":
                    valid = row["complete"] and length is not None
                    out.append((row["page_id"], row["url"], int(length[1]) if length else None, row["digest"], "revisit", row["refers_to"], valid, None))
                    continue
                framed = re.search(rb"(?i)^transfer-encoding:\s*chunked", head, re.M)
                payload = unchunked(body) if framed else body
                valid = row["complete"] and payload is not None and digest(payload) == row["digest"]
                payload = payload or b""
                out.append((row["page_id"], row["url"], len(payload), digest(payload), row["kind"], None, valid, payload))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
            names = [part.split()[0] for part in PAGES.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.select("kind", "page_id", "url", "digest", "refers_to", "complete", "block").mapInArrow(body, PAGES)


def archived(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """`pages` written to archives in the shared folder and read back: one row per input row, `valid` if
    nothing was lost on the way. No rows: no rows. Columns other than page_id, url and html are ignored."""
    spark = pages.sparkSession
    path = work_path(spark, "archives")
    write_archives(pages, path, segment)
    return payloads(reassembled(read_records(spark, path)))
