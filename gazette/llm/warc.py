"""Content-addressed WARC archive.

Payload bytes are stored once, keyed by SHA-256; record headers are stored apart, exactly as written; the records come back
by a join. Digests are verified on the way in (one length and one SHA-1 for a SHA-256) and on the way out.

Defined cases: a null payload is the empty payload; of records with equal payloads of at least ``min_payload`` bytes the one
with the largest key is the response and the others revisit it, smaller payloads are always responses; repeated rows of the
largest key are responses all, with one stored payload; a null key is smaller than any other; a null address has no
WARC-Target-URI; white space and control characters in an address are written as %XX; no rows give an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import stage

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    headers: DataFrame
    payloads: DataFrame


def base32(hexadecimal: Column, length: int = 40) -> Column:
    """Upper-case base32 of hexadecimal digits whose number is a multiple of five: five digits are four letters."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, at, 5), 16, 32), 4, "0") for at in range(1, length + 1, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def field(name: str, value: Column) -> Column:
    """A header line, empty for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def address(url: Column) -> Column:
    escaped = url
    for code in [*range(0x21), 0x7F]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), escaped).otherwise(url)


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Store one record per row and return the archive as read back."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    payloads = stage(rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("size").alias("size"), F.min("size").alias("least"), F.max("key").alias("keeper")), "warc-payloads")
    checked = F.when(F.col("size") != F.col("least"), F.raise_error(F.lit("two payloads have one digest"))).otherwise(base32(F.sha1("payload")))
    known = payloads.select("digest", "keeper", checked.alias("sha1"))
    records = rows.select("key", "url", "digest", "size").join(known, "digest")
    revisit = (F.col("size") >= min_payload) & ~F.col("key").eqNullSafe(F.col("keeper"))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", record_id(F.col("key"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", address(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        field("WARC-Profile", F.when(revisit, PROFILE)),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("keeper")))),
        field("Content-Type", F.when(~revisit, "text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit(CRLF),
    )
    return Archive(stage(records.select("key", "digest", F.encode(header, "UTF-8").alias("header")), "warc-headers"), payloads.select("digest", "payload"))


def verified(payloads: DataFrame) -> DataFrame:
    """Stored payloads, each compared with the digest it is stored under."""
    same = F.sha2("payload", 256) == F.col("digest")
    return payloads.withColumn("payload", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))))


def value_of(name: str) -> Column:
    """Value of a header field, null if the header does not have it."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def records(archive: Archive) -> DataFrame:
    """One row per record: key, whole record in WARC form, and its payload (of a revisit, that of the response)."""
    joined = archive.headers.join(verified(archive.payloads), "digest")
    body = F.when(value_of("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("key", "header", "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def catalogue(archive: Archive) -> DataFrame:
    """One row per rebuilt record: sizes and digests are taken again from its bytes, and compared with what its header says."""
    rows = records(archive).withColumn("sha1", base32(F.sha1("payload")))
    body = F.octet_length("record") - F.octet_length("header") - len(2 * CRLF)
    whole = (value_of("Content-Length").cast("long") == body) & (value_of("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "sha1"))
    digest = F.when(whole, F.col("sha1")).otherwise(F.raise_error(F.lit("header and record differ")))
    refers = F.regexp_extract(value_of("WARC-Refers-To"), r"(-?\d+)>$", 1).cast("long")
    return rows.select("key", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), value_of("WARC-Type").alias("record_type"), refers.alias("refers_to"))
