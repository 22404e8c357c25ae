"""Content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest; the exact record headers are stored separately, one row per record.
Original records come back through a join of both.  Of records with equal payloads of at least ``min_revisit`` bytes,
the one with the largest page_id is the response and the others are revisits of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Fixed lines of the formats: the WARC version, the HTTP head and the revisit profile of equal payloads.
VERSION = "WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """``heads``: (digest, head), the exact bytes of a record up to its payload. ``payloads``: (digest, payload)."""

    heads: DataFrame
    payloads: DataFrame


def _uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", min_revisit: int = 1000) -> Archive:
    """Write one record per row of ``pages`` (page_id long, url string, html string; other columns are ignored).

    The payload is the html in UTF-8; null is the empty payload.  A null page_id has an empty id in its record, and its
    record is always a response.  A null url has no WARC-Target-URI line; CR, LF and NUL in a url are percent-encoded.
    Rows that repeat a page_id of the response are responses too.  An empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.length("payload").cast("long"))
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    repeated = rows.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")

    heads = rows.withColumn("sha1", F.sha1("payload")).drop("payload").join(repeated, "digest", "left")
    revisit = F.coalesce(F.col("response") != F.col("page_id"), F.lit(False))
    url = F.col("url")
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), ("\0", "%00")):
        url = F.replace(url, F.lit(raw), F.lit(coded))
    length = F.when(revisit, F.lit(len(HTTP_HEAD))).otherwise(F.col("bytes") + len(HTTP_HEAD))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("response")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.lit(HTTP_HEAD))
    return Archive(stash(heads.select("digest", head.alias("head")), "heads"), stash(stored, "payloads"))


def _field(name: str) -> Column:
    value = F.regexp_extract("head", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("head").contains(f"\r\n{name}: "), value)


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def verified_payloads(archive: Archive) -> DataFrame:
    """(digest, payload, payload_bytes, payload_digest); fails if the bytes of a payload don't have its digest."""
    sound = F.sha2("payload", 256) == F.col("digest")
    held = archive.payloads.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("stored payload differs from its digest "), "digest"))))
    return held.select("digest", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))


def read_records(archive: Archive) -> DataFrame:
    """Every record: page_id, url, record_type, refers_to, payload_bytes, payload_digest of the full payload, ``payload``
    and ``record``, the original bytes (a revisit's record ends after its head, as it has no payload of its own).

    A record is rebuilt by the join and its fields are read from its bytes; a response fails if its block isn't as long
    as its head says or hasn't the digest that its head claims, a revisit if the payload it shares hasn't."""
    rows = archive.heads.join(verified_payloads(archive), "digest")
    head = F.encode("head", "UTF-8")
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    rows = rows.select("head", F.octet_length(head).alias("at"), "payload", "payload_bytes", "payload_digest", F.concat(head, body, F.lit(b"\r\n\r\n")).alias("record"))
    kind = _field("WARC-Type")
    size = F.octet_length("record") - F.col("at") - 4
    block = F.substring("record", F.col("at") + 1, size)
    digest = F.when(kind == "response", F.sha1(block)).otherwise(F.col("payload_digest"))
    sound = (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (_field("Content-Length").cast("long") == size + len(HTTP_HEAD))
    return rows.select(
        _page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        F.when(sound, kind).otherwise(F.raise_error(F.lit("a record differs from what its head claims"))).alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        F.when(kind == "response", size.cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        "payload",
        "record",
    )
