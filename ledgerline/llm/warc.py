"""WARC archives addressed by content.

An archive is two tables: ``payloads`` (digest, payload) holds the bytes of each
payload once under its SHA-256, and ``headers`` (page_id, digest, header) the
exact header block of every record.  A record is rebuilt by joining the two and
putting header, body and the closing blank lines together: a response's body is
its payload, a revisit has none and names the response that has it.  Both are
Parquet tables in a shared folder.

Of records with equal payloads of at least ``revisit_from`` bytes, that with the
largest page_id is the response and the others revisit it; all smaller ones are
responses.  Who is the largest comes from an aggregation over digests alone.
Payload bytes move once: each task keeps one copy of every payload that it has
read, so a payload that a third of the pages share moves once per task.  Reading
verifies every payload against its SHA-256, and each record's length and SHA-1
against its header, and fails on a mismatch.

Defined results: a null payload is an empty one; rows that repeat a page_id
write a record each, and share the role that their page_id has; a null page_id
is a record like any other, never a response to a revisit, and is the revisit of
another page of equal payload if there is one; a null url is an empty target;
line breaks of a url are left out; an empty table gives an empty archive; other
columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.sources.scratch import brief_shuffles

CRLF = "\r\n"
# Fixed value.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """Where the two tables of an archive lie."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"


def header_block(page_id: Column, url: Column, size: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """The header of a record, with its closing blank line; a revisit where ``refers_to`` is not null."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("unknown")), F.lit(">"))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    again = refers_to.isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(page_id)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(again, F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", urn(refers_to)))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(size).cast("string")),
        F.lit(CRLF),
    )


def write_archive(spark: SparkSession, pages: DataFrame, path: str, revisit_from: int = 1000, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes a record per row of ``pages`` (page_id, url, html), all captured at ``date``."""
    archive = Archive(path)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1")
    )
    facts = rows.select("page_id", "url", "digest", "size", "sha1")
    owners = facts.groupBy("digest").agg(F.max("page_id").alias("owner"))
    named = facts.join(owners.withColumnRenamed("digest", "__d"), F.col("digest") == F.col("__d"))
    again = (F.col("size") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    block = header_block(F.col("page_id"), F.col("url"), F.col("size"), F.col("sha1"), F.when(again, F.col("owner")), date)
    headers = named.select("page_id", "digest", block.cast("binary").alias("header"))
    # one row per digest: map-side partial aggregation drops copies before the bytes move
    stored = rows.groupBy("digest").agg(F.any_value("payload").alias("payload"))
    # the shuffled bytes go before the archive is read, which moves them again
    with brief_shuffles(spark):
        headers.write.option("compression", "zstd").parquet(archive.headers)
        stored.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def verified_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """(digest, payload), each payload checked against its digest as it is read."""
    stored = spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest")))
    return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")))


def _headers(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.schema("page_id long, digest string, header binary").parquet(archive.headers)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, header, payload, record): every original record, byte for byte, and the payload that it stands for."""
    payloads = verified_payloads(spark, archive).withColumnRenamed("digest", "__d")
    body = F.when(F.contains(F.col("header").cast("string"), F.lit(f"{CRLF}WARC-Type: revisit{CRLF}")), F.lit(b"")).otherwise(F.col("payload"))
    return (
        _headers(spark, archive)
        .join(payloads, F.col("digest") == F.col("__d"))
        .select("page_id", "header", "payload", F.concat("header", body, F.lit(CRLF * 2).cast("binary")).alias("record"))
    )


def parse_header(header: Column) -> dict[str, Column]:
    """Fields of a header block; a field that is absent is null."""
    text = header.cast("string")
    field = lambda name, pattern: F.nullif(F.regexp_extract(text, rf"(?md)^{name}: {pattern}\r$", 1), F.lit(""))
    return {
        "record_type": field("WARC-Type", r"(\w+)"),
        "target_uri": field("WARC-Target-URI", r"(.*?)"),
        "header_digest": field("WARC-Payload-Digest", r"sha1:([0-9a-f]{40})"),
        "refers_to": field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long"),
        "content_length": field("Content-Length", r"(\d+)").cast("long"),
    }


def read_index(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, record_type, target_uri, refers_to, payload_bytes, payload_digest) from the rebuilt records.

    A response's payload is cut out of its record, behind the header and as long
    as that says; a revisit's is the one that it stands for.
    """
    records = read_records(spark, archive)
    fields = parse_header(F.col("header"))
    parsed = records.select("page_id", "header", "payload", "record", *[c.alias(n) for n, c in fields.items()])
    body = F.expr("substring(record, length(header) + 1, cast(content_length as int))")
    whole = F.length("record") == F.length("header") + F.col("content_length") + 2 * len(CRLF)
    payload = F.when(F.col("record_type") == "response", body).otherwise(F.col("payload"))
    read = parsed.withColumn("body", payload).select(
        "page_id", "record_type", "target_uri", "refers_to", "header_digest", whole.alias("whole"), F.length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("payload_digest")
    )
    agrees = F.col("whole") & (F.col("header_digest") == F.col("payload_digest"))
    wrong = F.raise_error(F.concat(F.lit("header and payload disagree for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("unknown")))).cast("string")
    return read.select(
        "page_id", F.when(agrees, F.col("record_type")).otherwise(wrong).alias("record_type"), "target_uri", "refers_to", "payload_bytes", "payload_digest"
    )
