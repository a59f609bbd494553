"""WARC: a content-addressed archive.

Two tables: `blobs` holds each payload's bytes once under its SHA-256, `records` the exact header bytes of every
record. A record is rebuilt by joining its header to the blob it names; blobs are verified against their address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of fewer bytes are never stored as revisits.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: The standard's name for a revisit of an equal payload. Fixed value.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, page: str = "page_id", url: str = "url", body: str = "html", date: str = DATE
) -> None:
    """Write a record per row of pages below `path`.

    Null bodies are empty. Of equal payloads of at least 1000 bytes the greatest page is the response and the others
    are revisits of it; rows without a page id are responses, with an id made of their digest. Rows that repeat a page
    are records of their own. Line ends within a url are percent-encoded; a null url has no target line. A header
    holds the record's fields and the HTTP message's, which is what a revisit's block consists of. Every digest has one
    blob, whatever repeats. Payloads travel by (page, digest), never together with other pages' copies.
    """
    p = pages.select(
        F.col(page).alias("page"), F.col(url).alias("url"),
        F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"),
    )
    p = p.withColumn("digest", F.sha2("payload", 256))
    narrow = p.select("page", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    bearer = p.groupBy("digest").agg(F.max("page").alias("bearer"))
    # The blobs: one bearer's bytes for each digest, by one exchange for the join and for rows that repeat.
    at = F.concat_ws(":", "digest", "page")
    wanted = bearer.select(F.concat_ws(":", "digest", "bearer").alias("at"))
    blobs = p.select(at.alias("at"), "digest", "payload").join(wanted, "at").dropDuplicates(["at"])
    blobs.select("digest", "payload").write.parquet(f"{path}/blobs")
    r = narrow.join(bearer, "digest")
    refers = F.when((F.col("bytes") >= REVISIT_BYTES) & (F.col("page") < F.col("bearer")), F.col("bearer"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    message = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _field("Content-Type", F.lit("text/html;charset=utf-8")), _field("Content-Length", F.col("bytes")), F.lit(CRLF))
    length = F.octet_length(message) + F.when(refers.isNull(), F.col("bytes")).otherwise(F.lit(0))
    nameless = F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(refers.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        _field("WARC-Record-ID", F.coalesce(_record_id(F.col("page")), nameless)),
        _field("WARC-Target-URI", target),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Profile", F.when(refers.isNotNull(), F.lit(SAME_PAYLOAD))),
        _field("WARC-Refers-To", _record_id(refers)),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", length),
        F.lit(CRLF), message,
    )
    r.select(F.encode(header, "UTF-8").alias("header"), "digest").write.parquet(f"{path}/records")


def _parsed(records: DataFrame) -> DataFrame:
    h = F.decode("header", "UTF-8")
    get = lambda name, pattern: F.nullif(F.regexp_extract(h, rf"\r\n{name}: {pattern}\r\n", 1), F.lit(""))
    return records.select(
        "header", "digest",
        get("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page"),
        get("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        get("WARC-Type", r"(\w+)").alias("record_type"),
        get("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        get("WARC-Payload-Digest", r"sha1:([0-9a-f]+)").alias("said_sha1"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page, url, record_type, refers_to, payload_bytes, payload_digest (SHA-1 of the bytes read).

    Every blob is hashed once as it is read; a blob that is missing or does not match its address or the record's
    digest fails the query.
    """
    blobs = spark.read.parquet(f"{path}/blobs").select(
        "digest", (F.sha2("payload", 256) == F.col("digest")).alias("sound"), F.sha1("payload").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    r = _parsed(spark.read.parquet(f"{path}/records")).join(blobs, "digest", "left")
    sound = F.coalesce(F.col("sound") & (F.col("payload_digest") == F.col("said_sha1")), F.lit(False))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("bad blob "), F.col("digest"))))
    return r.select("page", "url", "record_type", "refers_to", "payload_bytes", checked.cast("string").alias("payload_digest"))


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """(page, record): the record's bytes, header, payload and closing line ends; a revisit has no payload of its own."""
    blobs = spark.read.parquet(f"{path}/blobs")
    r = _parsed(spark.read.parquet(f"{path}/records")).join(blobs, "digest")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return r.select("page", F.concat("header", block, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(page, payload): the full payload of every record, revisits included."""
    blobs = spark.read.parquet(f"{path}/blobs")
    return _parsed(spark.read.parquet(f"{path}/records")).join(blobs, "digest").select("page", "payload")
