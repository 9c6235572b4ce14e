"""Content-addressed web archive: payloads once by digest, headers apart, records rebuilt by joins.

An archive is a folder with two tables: `payloads` (digest, first, copies, payload), one row per distinct payload
under its SHA-256 with its smallest page_id, and `headers` (page_id, digest, header), the exact bytes of each record's header block.
The bytes of a record are `header || payload || CRLF CRLF`; a revisit record has an empty block, and its
page's payload is the one that its digest names.  All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

COPIES_PER_SALT = 4096
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: four runs of 40 bits, each eight digits of five bits."""
    sha = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def _record(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = DATE) -> str:
    """Write a record per row of `pages` (page_id, url, html); return the folder.

    Of rows with equal payloads of at least `min_bytes` bytes, that with the smallest page_id is a response
    and the others revisit it.  A null html is an empty payload.  A null url gives no target line; control
    characters in a url are percent-encoded, so that they cannot end a line.  Rows that repeat the
    smallest page_id are responses too.  A null page_id sorts last and is never referred to.  Other columns are left out.
    """
    folder = folder or scratch(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # one row per digest: a task sends each of its payloads once, however many copies it holds
    rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    firsts = pages.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "first")
    described = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1")).join(firsts, "digest")
    again = (F.col("size") >= min_bytes) & (F.col("first") != F.coalesce("page_id", F.col("first") - 1))
    revisit = F.coalesce(again, F.lit(False))
    url = F.col("url")
    for code in (9, 10, 13):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.regexp_replace(url, "[\\x00-\\x1f\\x7f]", "%20")
    kind = F.when(revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", F.coalesce(_record(F.col("page_id")), F.lit("<urn:page:>"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), _line("WARC-Refers-To", F.when(revisit, _record(F.col("first")))),
        _line("WARC-Profile", F.when(revisit, _PROFILE)), _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")), F.lit("\r\n"))
    described.select("page_id", "digest", header.cast("binary").alias("header")).write.parquet(f"{folder}/headers")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records: page_id, header, payload (in full, also of revisits), record (the record's exact bytes).

    Every stored payload is checked against its digest once.  A payload is dealt out in as many copies as its
    records need, `COPIES_PER_SALT` records to one, so that no digest fills a task.
    """
    wrong = F.raise_error(F.concat(F.lit("payload does not match digest "), "digest"))
    payloads = spark.read.parquet(f"{folder}/payloads").select("digest", "copies", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload"))
    salts = F.ceil(F.col("copies") / COPIES_PER_SALT).cast("int")
    counted = payloads.select("digest", salts.alias("salts"))
    hot = counted.where("salts > 1")
    headers = spark.read.parquet(f"{folder}/headers").join(hot, "digest", "left")
    headers = headers.withColumn("salt", F.pmod(F.xxhash64("page_id", "header"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    block = F.when(F.col("header").cast("string").contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(spread, ["digest", "salt"]).select("page_id", "header", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def describe(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the records' own bytes."""
    head = F.col("header").cast("string")
    field = lambda name, pattern: F.regexp_extract(head, f"\\r\\n{name}: {pattern}\\r\\n", 1)
    refers = field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>")
    page = field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>")
    number = lambda c: F.when(c != "", c.cast("long"))
    told = field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})")
    found = base32_sha1(F.col("payload"))
    return records.select(
        number(page).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(told == found, found).otherwise(F.raise_error(F.lit("payload does not match its record's digest"))).alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"), number(refers).alias("refers_to"))
