"""Content-addressed WARC archive.

Two tables make an archive: ``records`` holds the exact header bytes of every record (WARC and HTTP headers) with the
SHA-256 of its payload, ``payloads`` holds each payload once under that digest. Original records come back through a
join. A payload is only believed if its bytes hash to its key.

Defined cases: a null html is an empty payload; a null url leaves out WARC-Target-URI; line breaks in a url are
percent-encoded; rows that repeat a page_id are records of their own (all rows with the group's largest page_id are
responses); null page_ids rank below every other and are written as ``null``; extra columns are ignored; an empty
table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrostrat.llm.common import base32, scratch

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    path: str
    records: DataFrame
    payloads: DataFrame


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write ``pages`` (page_id, url, html) as an archive. Payloads below ``min_bytes`` are always full responses."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = pages.select("page_id", "url", F.sha2(payload, 256).alias("key"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n"))
    # The groups are pre-aggregated by task; the rows that join them are narrow, and a hot payload's are split by AQE.
    groups = facts.groupBy("key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    joined = facts.join(groups, "key", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n") >= min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("first_id")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        F.lit(CRLF),
        http,
    )
    joined.select(F.encode(head, "UTF-8").alias("head"), "key").write.option("compression", "zstd").parquet(f"{path}/records")
    pages.select(F.sha2(payload, 256).alias("key"), payload.alias("payload")).dropDuplicates(["key"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return read_archive(spark, path)


def read_archive(spark: SparkSession, path: str) -> Archive:
    return Archive(path, spark.read.schema("head binary, key string").parquet(f"{path}/records"), spark.read.schema("key string, payload binary").parquet(f"{path}/payloads"))


def parsed(archive: Archive) -> DataFrame:
    """Headers of every record, read from its bytes: page_id, url, record_type, payload_digest, refers_to, key."""
    text = F.decode("head", "UTF-8")
    field = lambda name, value=r"([^\r\n]*)": F.nullif(F.regexp_extract(text, rf"(?:^|\r\n){name}: {value}\r\n", 1), F.lit(""))
    number = r"<urn:x-page:(-?\d+)>"
    return archive.records.select(
        field("WARC-Record-ID", number).cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Payload-Digest", r"sha1:([A-Z2-7]*)").alias("payload_digest"),
        field("WARC-Refers-To", number).cast("long").alias("refers_to"),
        "key",
    )


def verified(archive: Archive) -> DataFrame:
    """Each stored payload's key, size and SHA-1, taken from its bytes; bytes that don't hash to their key fail the query."""
    good = F.when(F.sha2("payload", 256) == F.col("key"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("long"))
    return archive.payloads.select("key", good.alias("payload_bytes"), base32(F.sha1("payload")).alias("stored_digest"))


def index(archive: Archive) -> DataFrame:
    """One row per record, read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    return (
        parsed(archive)
        .join(verified(archive), "key", "left")
        .select("page_id", "url", "payload_bytes", F.when(F.col("payload_digest") == F.col("stored_digest"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
    )


def reconstruct(archive: Archive, full: bool = False) -> DataFrame:
    """The records' bytes (page_id, record). ``full`` gives revisits their payload too, as the original responses had."""
    body = F.col("payload") if full else F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    heads = archive.records.withColumn("record_type", F.regexp_extract(F.decode("head", "UTF-8"), r"WARC-Type: (\w+)", 1)).withColumn("page_id", F.regexp_extract(F.decode("head", "UTF-8"), r"WARC-Record-ID: <urn:x-page:(-?\d+)>", 1).try_cast("long"))
    return heads.join(archive.payloads, "key", "left").select("page_id", F.concat("head", body, F.lit(b"\r\n\r\n")).alias("record"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return index(write_archive(pages)).drop("url")


_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({v} >> {s}) & 31)::INT, 1)"
_QUAD = lambda i: " || ".join(_CHAR.format(v=f"('0x' || substr(h, {5 * i + 1}, 5))::BIGINT", s=s) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY sha256(body)) AS top FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {" || ".join(_QUAD(i) for i in range(8))} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM g"""
