"""Content-addressed WARC archive.

``write_archive`` keeps two tables in a shared folder: ``payloads`` (each distinct payload
once, under its SHA-256) and ``headers`` (the exact header bytes of every record, its
position key and the payload it refers to).  ``read_archive`` joins them on the
digest, checks every payload against its digest and rebuilds the original records;
``export_warc`` / ``import_warc`` turn records into plain WARC files and back.

Of records with equal payloads of at least ``min_revisit_bytes`` the one with the
largest id is the response and the others are revisits of it; smaller payloads
are always responses.

Digests and ids are narrow; payload bytes are shuffled once, after each task's copies have
gone, and a payload that a third of all records share is stored once and joined to headers
whose hot partitions AQE splits.

Defined results: a null payload is empty; a null url leaves its header line out, line
ends in a url are percent-encoded; records whose id is null are revisits of a
record with an id, else responses; rows that repeat the largest id are all responses
(of one stored payload); an empty table gives an empty archive.  Other columns of
the input may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editrisk.llm.common import discard, scratch_path, store

RECORD_URN = "urn:page:"
# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
MIN_REVISIT_BYTES = 1000


def _lines(*lines: Column) -> Column:
    """Header lines with their ends; null lines are left out."""
    return F.concat_ws("", *[F.concat(x, F.lit(END)) for x in lines])


def record_headers(records: DataFrame, date: str) -> Column:
    """The bytes before the payload, as text."""
    revisit = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit(f"<{RECORD_URN}"), c.cast("string"), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                  F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")), F.lit(""))
    block = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    head = _lines(
        F.lit(VERSION), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", block.cast("string")), F.lit(""))
    return F.concat(head, http)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "1970-01-01T00:00:00Z",
                  min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write ``path/payloads`` and ``path/headers``; returns the path."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    narrow = store(pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.sha2(payload, 256).alias("payload_key"), F.sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("payload_bytes")), "warc-digests")
    holders = store(narrow.groupBy("payload_key").agg(F.max("page_id").alias("holder")), "warc-holders")
    again = (F.col("payload_bytes") >= min_revisit_bytes) & F.col("holder").isNotNull() \
        & ~F.col("page_id").eqNullSafe(F.col("holder"))
    records = narrow.join(holders, "payload_key").withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"),
        "refers_to": F.when(again, F.col("holder"))})
    (records.withColumn("header", record_headers(records, date))
     .select("page_id", "header", "payload_key").write.parquet(f"{path}/headers"))

    full = pages.select(F.sha2(payload, 256).alias("payload_key"), payload.alias("payload"))
    (full.groupBy("payload_key").agg(F.first("payload").alias("payload"))
     .write.parquet(f"{path}/payloads"))
    discard(narrow, holders)
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``record_id, record_type, url, refers_to`` (as the header has
    them), ``header``, ``payload`` (of a revisit: the payload it refers to), ``payload_digest``.

    A payload that does not match its key or its header's digest fails the job.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    good = payloads.withColumn("payload", F.when(
        F.sha2("payload", 256) == F.col("payload_key"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_key")))))
    good = good.withColumn("payload_digest", F.sha1("payload"))
    joined = headers.join(good, "payload_key", "left")
    field = lambda name: F.nullif(F.regexp_extract(
        "header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    out = joined.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("stated"), "header", "payload", "payload_digest")
    matches = F.col("stated") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    return out.withColumn("payload", F.when(matches, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("missing or wrong payload of "), F.col("header"))))).drop("stated")


def record_bytes() -> Column:
    """A record of ``read_archive`` as written in a WARC file, without its end."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.col("header").cast("binary"), body)


def rebuilt_records(spark: SparkSession, path: str) -> DataFrame:
    """``read_archive`` with ``record``: header and payload put together again.  A record whose
    block is not as long as its header says fails the job."""
    head = F.regexp_extract("header", r"(?s)^(WARC/.*?\r\n\r\n)", 1)
    stated = F.regexp_extract(head, r"\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("long")
    record = record_bytes()
    fits = F.octet_length(record) - F.octet_length(head) == stated
    return read_archive(spark, path).withColumn("record", F.when(fits, record).otherwise(
        F.raise_error(F.concat(F.lit("wrong length of record "), F.col("header")))))


def export_warc(records: DataFrame, path: str, records_per_file: int = 10_000) -> str:
    """Write records as plain WARC files of bounded length; a record ends with two line ends."""
    (records.select(record_bytes().cast("string").alias("value")).write
     .option("lineSep", END + END).option("maxRecordsPerFile", records_per_file).text(path))
    return path


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, url, refers_to, payload`` of WARC files (a file is one
    task's work, so ``export_warc`` bounds its records); a malformed file fails."""

    def parse(data: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = data[at:end].decode().split(END)
            if not head[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {at}")
            fields = dict(line.split(": ", 1) for line in head[1:])
            start, length = end + 4, int(fields["Content-Length"])
            block = data[start:start + length]
            payload = block[block.index(b"\r\n\r\n") + 4:]
            yield (fields.get("WARC-Record-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"),
                   fields.get("WARC-Refers-To"), payload)
            at = start + length + 4

    def rows(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "record_type", "url", "refers_to", "payload"]
        for batch in files:
            for content in batch["content"]:
                yield pd.DataFrame(list(parse(bytes(content))), columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(
        rows, "record_id string, record_type string, url string, refers_to string, payload binary")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder, read it back and rebuild every
    record: one row per page with ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``, read off the rebuilt record's own bytes (the digest has been checked
    against the payload)."""
    spark = pages.sparkSession
    path = write_archive(pages, scratch_path(spark, "warc"), **options)
    head = F.substring("record", F.lit(1), F.octet_length("header")).cast("string")
    field = lambda name, value: F.regexp_extract("head", rf"\r\n{name}: {value}\r\n", 1)
    number = lambda name: F.nullif(field(name, r"<[^>\r\n]*?(-?\d+)>"), F.lit("")).cast("long")
    length = F.regexp_extract("head", r"\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("long")  # the last: of the payload
    return rebuilt_records(spark, path).withColumn("head", head).select(
        number("WARC-Record-ID").alias("page_id"), length.alias("payload_bytes"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})").alias("payload_digest"),
        field("WARC-Type", "(response|revisit)").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"))
