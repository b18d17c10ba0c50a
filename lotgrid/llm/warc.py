"""WARC archives: one transaction per page, written and assembled again.

A capture is three records: a request, a response (or a revisit of an equal payload) and a
metadata record.  Request and metadata name the response in ``WARC-Concurrent-To``; reading
joins the three through that identifier into one nested row.

Records are built with built-in functions and written by Spark's text writer, whose line
separator is the blank double line that ends a WARC record.  Files hold a bounded number of
records; a reading task parses one file after another by ``Content-Length``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrid.llm.common import stored
from lotgrid.session import scratch_path

# Payloads below this size are never stored as revisits.
MIN_REVISIT_BYTES = 1000
# Three records a capture; a file is one reading unit.
CAPTURES_PER_FILE = 1000

END = "\r\n\r\n"
NO_URL = "about:blank"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("capture", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("http", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _record(headers: list[Column], block: Column) -> Column:
    """One record without its final separator; the length counts bytes of the block."""
    return F.concat(F.lit("WARC/1.1\r\n"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit(END), block)


def _head(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_captures(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, captures_per_file: int = CAPTURES_PER_FILE) -> None:
    """Write ``pages(page_id, url, html)`` as gzip-compressed WARC files under ``path``.

    A null html is the empty payload, a null url is written as ``about:blank``, a null
    page_id is left out.  Of rows with equal payloads of at least ``min_revisit_bytes``,
    those with the largest page_id are responses and the others revisits; a repeated row is
    a capture of its own.  Only payload digests are shuffled to find equal payloads.
    """
    base = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    equal = (
        base.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"))
        .where("n > 1")
    )
    # Usually few digests repeat; their stored size tells Spark whether pages have to move.
    equal = stored(equal, "warc_equal")
    rows = base.join(equal, "digest", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "html", "digest", "first_url", F.coalesce("url", F.lit(NO_URL)).alias("url"), revisit.alias("revisit"))
    rows = rows.select(
        "*",
        *[F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias(f"{k}_id") for k in ("request", "main", "metadata")],
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )

    def common(kind: Column, own: str) -> list[Column]:
        return [_head("WARC-Type", kind), _head("WARC-Record-ID", F.col(own)), _head("WARC-Date", F.col("date")), _head("WARC-Target-URI", F.col("url"))]

    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    length = F.octet_length("html").cast("string")
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    request = _record(
        [*common(F.lit("request"), "request_id"), _head("WARC-Concurrent-To", F.col("main_id")), F.lit("Content-Type: application/http;msgtype=request\r\n")],
        F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    main = _record(
        [
            *common(F.when(F.col("revisit"), "revisit").otherwise("response"), "main_id"),
            _head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            _head("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
            _head("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), F.coalesce("first_url", F.lit(NO_URL)))),
            F.lit("Content-Type: application/http;msgtype=response\r\n"),
        ],
        F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html"))),
    )
    metadata = _record(
        [*common(F.lit("metadata"), "metadata_id"), _head("WARC-Concurrent-To", F.col("main_id")), F.lit("Content-Type: application/warc-fields\r\n")],
        F.concat(_head("pageId", F.col("page_id").cast("string")), _head("payloadLength", length)),
    )
    records = rows.select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.options(lineSep=END, compression="gzip", maxRecordsPerFile=3 * captures_per_file).text(path)


def _chunks(content: bytes) -> Iterator[bytes]:
    """Plain bytes of a file that is or is not compressed, member by member."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        feed, content = content, b""
        while feed:
            yield member.decompress(feed, 1 << 22)
            feed = member.unconsumed_tail
        yield member.flush()
        content = member.unused_data


def parse_records(content: bytes, payloads: bool = True) -> Iterator[dict]:
    """Records of one archive file.  ``payloads=False`` keeps size and digest, not the text."""
    chunks, buffer = _chunks(content), bytearray()

    def need(n: int) -> bool:
        while len(buffer) < n:
            piece = next(chunks, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        while need(1) and buffer[:1] in (b"\r", b"\n"):
            del buffer[: len(buffer) - len(buffer.lstrip(b"\r\n"))]
        if not buffer:
            return
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not need(len(buffer) + 1):
                raise ValueError("archive ends inside a record header")
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(head["content-length"])
        if not need(end + 4 + size):
            raise ValueError("archive ends inside a record block")
        block = bytes(memoryview(buffer)[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]
        kind = head.get("warc-type", "")
        out = {
            "record_id": head.get("warc-record-id"),
            "type": kind,
            "capture": head.get("warc-concurrent-to") or head.get("warc-record-id"),
            "url": None if head.get("warc-target-uri") == NO_URL else head.get("warc-target-uri"),
            "date": head.get("warc-date"),
            "digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "payload_bytes": None,
            "http": None,
            "payload": None,
            "fields": None,
        }
        if "application/http" in head.get("content-type", ""):
            http, _, payload = block.partition(b"\r\n\r\n")
            out["http"] = http.decode("utf-8", "replace")
            if kind == "response":
                out["payload_bytes"] = len(payload)
                found = hashlib.sha1(payload).hexdigest()
                if out["digest"] not in (None, found):
                    raise ValueError(f"payload of {out['record_id']} does not have its digest")
                out["digest"] = found
                if payloads:
                    out["payload"] = payload.decode("utf-8", "replace")
        elif "application/warc-fields" in head.get("content-type", ""):
            pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if line)
            out["fields"] = {k: v.strip() for k, _, v in pairs}
        yield out


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records under ``path``, one row each."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for row in parse_records(bytes(content), payloads):
                    rows.append(row)
                    if len(rows) == 1500:
                        yield pd.DataFrame(rows, columns=RECORD.names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=RECORD.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture, request, main, metadata``.

    Records meet through the response they are concurrent to.  ``main`` is the response or
    revisit; a part whose record is missing is null, and of several metadata records their
    fields are all kept, in ``metadata``.
    """
    kind = F.col("type")
    part = F.struct("record_id", "type", "url", "date", "digest", "payload_bytes", "http", "payload")
    return records.groupBy("capture").agg(
        F.max(F.when(kind == "request", F.struct("record_id", "url", "date", "http"))).alias("request"),
        F.max(F.when(kind.isin("response", "revisit"), part)).alias("main"),
        F.collect_list(F.when(kind == "metadata", F.col("fields"))).alias("metadata"),
    )


def resolve_revisits(captures: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Digest columns of each capture; a revisit finds its response by payload digest."""
    field = lambda k: F.try_element_at(F.get(F.col("metadata"), F.lit(0)), F.lit(k)).cast("bigint")
    flat = captures.where("main IS NOT NULL").select(
        field("pageId").alias("page_id"),
        F.coalesce("main.payload_bytes", field("payloadLength")).alias("payload_bytes"),
        F.col("main.digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
    )
    first = (
        flat.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_revisit_bytes))
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("response_id"))
        .withColumn("record_type", F.lit("revisit"))
    )
    return flat.join(first, ["payload_digest", "record_type"], "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("response_id").alias("refers_to")
    )


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages as archives in the shared folder, read them back, one row per page."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "warc")
    write_captures(pages, path, min_revisit_bytes)
    captures = assemble(read_records(spark, path, payloads=False))
    return resolve_revisits(stored(captures, "warc_captures"), min_revisit_bytes)


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> m THEN m END AS refers_to
FROM w
"""
