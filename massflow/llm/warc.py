"""WARC archives: written with one transaction per page, read back and assembled.

A transaction is a request, a response (or a revisit of an earlier response with
the same payload) and a metadata record, joined through WARC-Concurrent-To into
one nested row per capture.

Spark's own writer makes the archives, so they may lie in any store that Spark
can write to, and a lost task leaves no part of a file behind. A record is text:
its payload is a string in UTF-8. The reader takes any payload, goes by
Content-Length and streams through the decompressed file.

Defined results: a null payload is empty; a null url gives no WARC-Target-URI
and reads back as null; of equal payloads of at least ``min_bytes`` bytes, the
row with the smallest page_id (null last, then the first read) is the response;
repeated rows are captures of their own; an empty table gives no archive rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.llm.common import row_id, scratch_path, stored, table

CRLF = "\r\n"
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 6000

RECORD = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("warc_type", T.StringType()),
            ("record_id", T.StringType()),
            ("concurrent_to", T.StringType()),
            ("refers_to", T.StringType()),
            ("uri", T.StringType()),
            ("date", T.StringType()),
            ("content_type", T.StringType()),
            ("block_head", T.StringType()),
            ("payload_bytes", T.LongType()),
            ("payload_digest", T.StringType()),
            ("digest_ok", T.BooleanType()),
            ("payload", T.BinaryType()),
        )
    ]
)


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of ``payload`` in base 32: 160 bits as four groups of 40."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as captures with payload, digest, record type and what a revisit refers to."""
    scan = pages.select(row_id().alias("rid"), "page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    light = stored(scan.select("rid", "page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "payloads")
    key = F.concat_ws(":", "digest", "n")
    groups = light.groupBy("digest", "n").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "rid")).alias("first")).select(key.alias("k"), "first")
    first = (F.col("rid") == F.col("first.rid")) | (F.col("n") < min_bytes)
    types = light.withColumn("k", key).join(groups, "k").select(
        "rid", F.col("digest").alias("known"), F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("first.rid")).alias("refers_rid")
    )
    return scan.join(types, "rid").withColumn("digest", F.when(F.col("digest") == F.col("known"), F.col("digest")).otherwise(F.raise_error(F.lit("the table changed between two scans")))).drop("known")


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends that close it; a null header is left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_archives(captures: DataFrame, path: str, date: str = DATE, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Three records per capture, as gzipped archives under ``path``."""
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    main, at = urn(F.lit("main"), F.col("rid")), ("WARC-Date", F.lit(date))
    body = F.decode("payload", "UTF-8")
    head = F.concat_ws(CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length("payload").cast("string")), F.lit(""), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    host = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("unknown.invalid"))
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", urn(F.lit("request"), F.col("rid"))), at, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit(f"GET / HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
    )
    response = _record(
        F.col("record_type"),
        [
            ("WARC-Record-ID", main), at, ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, urn(F.lit("main"), F.col("refers_rid")))), ("WARC-Profile", F.when(revisit, PROFILE)), ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, body)),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", urn(F.lit("metadata"), F.col("rid"))), at, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    captures.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parsed(stream: io.BufferedIOBase, with_payload: bool) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        block = stream.read(int(headers["content-length"]))
        kind = headers.get("warc-type")
        is_http = headers.get("content-type", "").startswith("application/http")
        head, _, payload = block.partition(b"\r\n\r\n") if is_http else (block, b"", b"")
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
        yield (
            kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"),
            headers.get("content-type"), head.decode("utf-8", "replace"), len(payload), real or stated, real is None or stated in (None, real), payload if with_payload else None,
        )


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, gzipped or not, by whole files."""
    names = [f.name for f in RECORD.fields]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                rows = []
                for row in _parsed(stream, with_payload):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: uri, date, request, response, metadata.

    The request and the metadata record name the response (or revisit) in their
    concurrent_to; either may be missing and is then null.
    """
    side = lambda kind: records.where(F.col("warc_type") == kind).select("concurrent_to", F.struct("record_id", "content_type", "block_head").alias(kind))
    main = records.where(F.col("warc_type").isin("response", "revisit")).select(
        F.col("record_id").alias("concurrent_to"), "uri", "date", F.struct("record_id", "warc_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "block_head", "payload").alias("response")
    )
    return main.join(side("request"), "concurrent_to", "left").join(side("metadata"), "concurrent_to", "left").drop("concurrent_to")


def captures_read(spark: SparkSession, path: str) -> DataFrame:
    """Per capture of the archives under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, uri."""
    records = stored(read_records(spark, path, with_payload=False), "records")
    number = F.regexp_extract("metadata.block_head", r"pageId: (-?[0-9]+)", 1)
    rows = assembled(records).select(
        F.when(number != "", number.cast("long")).alias("page_id"), "uri", F.col("response.record_id").alias("id"), F.col("response.refers_to").alias("refers"), F.col("response.warc_type").alias("record_type"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.payload_bytes").alias("n"), (F.col("request.record_id").isNotNull() & F.col("response.digest_ok")).alias("whole"),
    )
    rows = stored(rows, "captures")
    originals = rows.where("record_type = 'response'").select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("n").alias("full"))
    return rows.join(originals, "refers", "left").select("page_id", F.coalesce("full", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "uri", "whole")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(with_record_types(table(spark, sf_dir, "pages")), path)
    return captures_read(spark, path).drop("uri", "whole")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([3, 2, 1, 0], lambda j:
    substr('{BASE32}', CAST((CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT) >> (5 * j)) & 31 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
