"""WARC archives of pages: a writer that marks repeated payloads as revisits, and a reader that
verifies record boundaries.

The writer is DataFrame operations alone: a record is a line of Spark's text writer whose line
separator is the blank line that ends a WARC record, so files of the format arise in any store. The
reader scans files for the magic, wherever it stands: each candidate gives the offset of its
successor. Payloads may hold the magic or whole records, so a candidate counts only if it can be
reached from the start of its file, which pointer jumping finds: a task follows STRIDE successors of
each candidate of its file, and joins double that jump until every chain has ended.

Defined results: a null html is an empty payload; a null url is empty; line breaks in a url become
spaces; of rows with equal payloads those with the smallest page_id are responses (repeated rows of
it too), and where no row of a payload has a page_id all are; a file whose chain breaks gives the
records before the break; other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import materialize, shared_dir, table

#: How many records a file has at most, by the bytes of their payloads: 64 MB and their headers, or one record.
FILE_RECORDS = ((16 << 10, 4096), (1 << 20, 64), (None, 1))
#: Payloads of repeated pages are looked up by broadcast up to so many.
BROADCAST_REPEATED = 200_000
#: Successors that a task follows from each candidate.
STRIDE = 32
MIN_BYTES = 0

# RFC 4648's base32 digits, and the digits of conv() for base 32.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
URN = "urn:bookloom:page:"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"(?im)^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r?$")


def base32_sha1(hexadecimal: Column) -> Column:
    """The 32 base32 digits of a SHA-1 given as 40 hexadecimal ones: 40 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Each page's WARC record (without the blank line that ends it) as `value`, and the bytes of its payload."""
    p = pages.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    repeated = p.where(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialize(repeated.select(F.col("sha1").alias("of"), "first"), "repeated")
    few = repeated.limit(BROADCAST_REPEATED + 1).count() <= BROADCAST_REPEATED
    p = p.join(F.broadcast(repeated) if few else repeated, F.col("sha1") == F.col("of"), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return p.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("key")), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("sha1")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length, F.lit("\r\n\r\n"),
        http, F.when(revisit, "").otherwise(F.col("html")),
    ).alias("value"), "bytes")


def write(pages: DataFrame, path: str, **columns) -> None:
    """Writes archives whose size is bounded: longer payloads, where there are any, in files of fewer records."""
    every, above = records(pages, **columns), -1
    most = pages.agg(F.max(F.octet_length(columns.get("html", "html")))).first()[0] or 0
    for size, count in FILE_RECORDS:
        part = every.where(F.col("bytes") > above) if size is None else every.where(F.col("bytes").between(above + 1, size))
        part.select("value").write.mode("append" if above >= 0 else "error").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", count).text(path)
        if size is None or most <= size:
            break
        above = size


def scan(data: bytes) -> dict[int, tuple]:
    """Every candidate record of a file by its offset: successor, header fields, and where its block begins and ends.

    A header ends at the first blank line and holds lines of fields alone, so a magic that is followed by another one
    before a blank line is no header; each byte is therefore looked at for one candidate at most.
    """
    found, n = {}, len(data)
    starts = [m.span() for m in _MAGIC.finditer(data)]
    head = -1
    for i, (at, begin) in enumerate(starts):
        if head < begin:
            head = data.find(b"\r\n\r\n", begin - 2)
            if head < 0:
                break
        if i + 1 < len(starts) and starts[i + 1][0] <= head:
            continue
        fields = {k.lower(): v for k, v in _FIELD.findall(data[begin : head + 2])}
        length = fields.get(b"content-length", b"")
        end = head + 4 + int(length) if length.isdigit() and len(length) < 16 else n + 1
        if data[end : end + 4] == b"\r\n\r\n":
            found[at] = (end + 4, fields, head + 4, end)
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record that is reachable from the start of its file: file, offset, record_id, record_type, refers_to, uri, digest (as declared), payload_bytes, payload_digest (of what the record holds; a revisit's of what its response holds) and intact: the declared digest is that of the payload, and a revisit's response exists, is one, and has as many bytes as the revisit states."""
    schema = "file string, offset long, jump long, path array<long>, n long, record_id string, record_type string, refers_to string, uri string, digest string, payload_bytes long, payload_digest string"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                found = scan(data)
                rows = []
                for at, (_, fields, begin, end) in found.items():
                    steps = [at]
                    while len(steps) <= STRIDE and (to := found[steps[-1]][0]) in found:
                        steps.append(to)
                    jump = steps.pop() if len(steps) > STRIDE else None
                    declared = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                    head = data.find(b"\r\n\r\n", begin, end)
                    begin = head + 4 if head >= 0 else begin
                    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
                    if kind == "revisit":
                        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", data[found[at][2] : begin])
                        size, digest = int(stated[1]) if stated else None, None
                    else:
                        size, digest = end - begin, base64.b32encode(hashlib.sha1(memoryview(data)[begin:end]).digest()).decode()
                    text = [fields.get(k, b"").decode("utf-8", "replace") for k in (b"warc-record-id", b"warc-refers-to", b"warc-target-uri")]
                    rows.append((file, at, jump, steps, len(found), text[0], kind, text[1] or None, text[2], declared, size, digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    found = materialize(files.mapInArrow(candidates, schema), "candidates")
    most = found.agg(F.max("n")).first()[0] or 0
    reached = found.where("offset = 0").select("file", "offset")
    jumps = found.where("jump IS NOT NULL").select("file", "offset", "jump")
    for _ in range(max(0, math.ceil(math.log2(max(1, most) / STRIDE)))):
        far = reached.join(jumps, ["file", "offset"]).select("file", F.col("jump").alias("offset"))
        reached = materialize(reached.unionByName(far), "reached")
        then = jumps.select("file", F.col("offset").alias("jump"), F.col("jump").alias("next"))
        jumps = materialize(jumps.join(then, ["file", "jump"]).select("file", "offset", F.col("next").alias("jump")), "jumps")
    steps = reached.join(found.select("file", "offset", "path"), ["file", "offset"]).select("file", F.explode("path").alias("offset"))
    kept = found.drop("jump", "path", "n").join(steps, ["file", "offset"])
    kept = materialize(kept, "records")
    # Each response that is referred to is looked up once: of several with one identifier, equal payloads count as one.
    wanted = kept.where("record_type = 'revisit' AND refers_to IS NOT NULL").select(F.col("refers_to").alias("wanted")).distinct()
    held = kept.where("record_type <> 'revisit'").join(wanted, F.col("record_id") == F.col("wanted"), "left_semi").groupBy("record_id").agg(F.min("payload_digest").alias("of_digest"), F.max("payload_digest").alias("last"), F.min("payload_bytes").alias("of_bytes"))
    held = held.where(F.col("of_digest") == F.col("last")).select(F.col("record_id").alias("of"), "of_digest", "of_bytes")
    few = held.limit(BROADCAST_REPEATED + 1).count() <= BROADCAST_REPEATED
    kept = kept.join(F.broadcast(held) if few else held, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("of")), "left")
    revisit, digest = F.col("record_type") == "revisit", F.coalesce("payload_digest", "of_digest")
    same = (F.col("digest") == digest) & (~revisit | (F.col("payload_bytes") == F.col("of_bytes")))
    return kept.select("file", "offset", "record_id", "record_type", "refers_to", "uri", "digest", "payload_bytes", digest.alias("payload_digest"), F.coalesce(same, F.lit(False)).alias("intact"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{URN}([^>]*)', 1) AS BIGINT)")
    return read(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact")


#: The same rows in DuckDB, from the pages alone. Base32 of 160 bits, 5 at a time.
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT h, first, list_reduce(list_transform(range(1, 41), lambda i: lpad(to_binary(strpos('0123456789abcdef', h[i]) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM f)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: '{BASE32}'[1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(bits[5 * i + j] AS INTEGER) * (1 << (5 - j)))) AS INTEGER)]), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM p JOIN b USING (h)
"""
