"""WARC records in a content-addressed archive.

The archive is two tables. ``payloads`` holds each distinct payload once under
its SHA-256 digest; ``records`` holds the exact header bytes of every record
with the digest of the payload that belongs to it. A record's bytes are header,
payload and the closing blank lines, put together again by a join.

Of records with equal payloads the one with the smallest id is a ``response``;
the others are ``revisit`` records, which have no block of their own and refer
to that response. Payloads under ``min_revisit_bytes`` are never revisited.

Nulls: a null payload is the empty payload, a null id counts as larger than any
other, a null URL gives an empty target. Rows that repeat an id and a payload
are separate records: one of them is the response, the others revisit it.
Extra columns are ignored. Empty input gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, shared_dir

#: The RFC 4648 base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


#: What a revisit record has to name. Fixed value.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hex digits: every 5 hex digits (20 bits) give 4 characters."""
    out = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def page_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    body = F.coalesce(col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(col(page_id).cast("long").alias("page_id"), F.coalesce(col(url).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def build_records(rows: DataFrame, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row per page: page_id, digest, header, has_block. Only narrow columns are shuffled."""
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("id"), F.col("url"))
    first = narrow.groupBy("digest").agg(F.min(order).alias("first"))  # one row per digest and task before the shuffle
    joined = narrow.join(first, "digest").withColumn("leads", order == F.col("first"))
    # Rows that repeat an id, a URL and a payload: one of them leads.
    leads = joined.filter("leads").withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("page_id")))
    both = leads.unionByName(joined.filter("not leads").withColumn("nth", F.lit(2)))
    is_response = (F.col("nth") == 1) | (F.col("n") < min_revisit_bytes)
    first_id = F.nullif(F.col("first.id"), F.lit(2**63 - 1))
    return both.select("page_id", "digest", header(is_response, first_id, date).alias("header"), is_response.alias("has_block"))


def header(is_response: Column, first_id: Column, date: str) -> Column:
    """The exact header bytes of a record, from page_id, url, sha1 and n."""
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(is_response, "").otherwise(F.concat(line("WARC-Refers-To", uri(first_id)), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Length", F.when(is_response, F.col("n")).otherwise(F.lit(0)).cast("string")),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, **columns) -> None:
    """Writes both tables under ``path``: every header, and every distinct payload once."""
    rows = page_rows(pages, **columns)
    build_records(rows, min_revisit_bytes).write.parquet(f"{path}/records")
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Reconstructs the records: page_id, digest, header, block (empty for a revisit), payload_bytes, sha1.

    Every payload is hashed again; one that doesn't have the digest it is stored under raises an error.
    """
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary")
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload"))
    facts = payloads.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    records = spark.read.parquet(f"{path}/records").join(facts, "digest")
    return records.select("page_id", "digest", "header", F.when(F.col("has_block"), F.col("payload")).otherwise(F.lit("").cast("binary")).alias("block"), "payload_bytes", "sha1")


def record_bytes() -> Column:
    """A whole record: header, blank line, block, two line ends."""
    end = F.lit(CRLF).cast("binary")
    return F.concat(F.col("header"), end, F.col("block"), end, end)


def header_field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def archive_pages(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes an archive of ``pages`` to ``path``, reads it back and describes each record from what was read."""
    write_archive(pages, path, **options)
    got = read_archive(pages.sparkSession, path)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    return got.select(
        page(header_field("WARC-Record-ID")).alias("page_id"),
        "payload_bytes",
        base32_of_hex(F.col("sha1")).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        page(header_field("WARC-Refers-To")).alias("refers_to"),
    )


def new_archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/actflow/warc-{uuid.uuid4().hex}"


def write_warc_files(records: DataFrame, path: str) -> None:
    """Plain WARC files, one per partition, for records whose blocks are UTF-8 text."""
    whole = F.concat(F.col("header"), F.lit(CRLF).cast("binary"), F.col("block")).cast("string")
    records.select(whole).write.option("lineSep", CRLF + CRLF).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file, gzipped or not; the header ends before the blank line."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 2
        size = int(re.search(rb"\r\nContent-Length: *([0-9]+)\r\n", data[at:end], re.I)[1])
        block = data[end + 2 : end + 2 + size]
        if len(block) < size or data[end + 2 + size : end + 6 + size] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} is cut short")
        yield data[at:end], block
        at = end + 6 + size


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()
