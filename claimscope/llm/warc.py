"""Content-addressed WARC archive.

Payload bytes are stored once, keyed by their SHA-256; every record's exact header block is
stored apart, and a reader joins both into the original records.  A reader verifies length and
digest of what it joined.  Of records with equal payloads of ``revisit_from`` bytes or more, the
one of the smallest page id is a response and the others revisit it; shorter payloads are always
responses.  ``export_text`` writes plain WARC files.

Skew: a payload that a third of all pages share is found by a pre-aggregated minimum; the joins
read written tables, so that both sides are plain exchanges whose hot partitions can be split.

Edge cases: a null payload is empty; a null URL is an empty target; repeated page ids make
records of their own; a null page id sorts before all others; an empty table makes an empty
archive; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import shared_path, table

REVISIT_FROM = 100
LEAST = -(1 << 63)  # stands for a null page id
CRLF = "\r\n"



def _field(name: str):
    return F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)$", 1)


def _keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")
    ).select("page_id", F.coalesce("page_id", F.lit(LEAST)).alias("page_key"), "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("size"), "payload")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = REVISIT_FROM) -> str:
    """Write the archive's two tables below ``path``: payloads (digest, payload) and headers (one
    row per record: page_id, header).  Returns ``path``."""
    spark = pages.sparkSession
    keyed = _keyed(pages, id_col, url_col, payload_col)
    light = keyed.drop("payload")
    # the first page of each digest; pages without an id come first
    firsts = light.groupBy("digest").agg(F.min("page_key").alias("first_key"))
    firsts.write.parquet(f"{path}/firsts")
    firsts = spark.read.schema(firsts.schema).parquet(f"{path}/firsts")

    # one copy of each payload: that of the first page; the last step only meets repeated rows of one
    # page and needs no shuffle of its own
    owners = firsts.withColumnRenamed("first_key", "page_key")
    stored = keyed.join(owners, ["digest", "page_key"], "left_semi").dropDuplicates(["digest", "page_key"]).select("digest", "payload")
    stored.write.parquet(f"{path}/payloads")

    first = light.join(firsts, "digest")
    revisit = (F.col("size") >= revisit_from) & (F.col("page_key") != F.col("first_key"))
    # repeated rows of the first page: page_id is equal, so all of them are responses
    block = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"),
            F.when(F.col("first_key") != LEAST, F.col("first_key").cast("string")).otherwise(""), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(f"{CRLF}{CRLF}"),
    )
    first.select("page_id", "digest", block.alias("header")).write.parquet(f"{path}/headers")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: page_id, header fields, payload (of revisits too), record (header block,
    payload and the closing blank lines).  A record whose payload is absent or differs from the
    header's digest or length has ``verified`` false; it isn't dropped."""
    headers = spark.read.schema("page_id bigint, digest string, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    # the store's own digests are verified once per payload, not once per record
    payloads = payloads.select("digest", "payload", F.sha2("payload", 256).alias("payload_digest"))
    fields = headers.select(
        "page_id", "header", "digest",
        _field("WARC-Type").alias("record_type"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Payload-Digest").alias("stated_digest"), _field("Content-Length").cast("bigint").alias("stated_bytes"),
        F.regexp_extract("header", r"(?m)^WARC-Refers-To: <urn:page:(-?\d*)>$", 1).alias("refers"),
    )
    joined = fields.join(payloads, "digest", "left")
    record = F.concat(F.col("header").cast("binary"), F.col("payload"), F.lit(CRLF * 2).cast("binary"))
    size = F.octet_length("payload").cast("bigint")
    return joined.select(
        "page_id", "record_type", "url", F.when(F.col("refers") != "", F.col("refers").cast("bigint")).alias("refers_to"),
        size.alias("payload_bytes"), "payload_digest",
        F.coalesce((F.col("stated_digest") == F.concat(F.lit("sha256:"), "payload_digest")) & (F.col("stated_bytes") == size), F.lit(False)).alias("verified"),
        "header", "payload", record.alias("record"),
    )


def export_text(records: DataFrame, path: str) -> None:
    """Plain WARC files: header block and payload of each record, closed by two line ends."""
    body = F.concat(F.col("header").cast("binary"), F.col("payload"))
    records.select(body.cast("string").alias("value")).write.option("lineSep", CRLF * 2).text(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    records = read_archive(spark, path)
    payload = F.substring("record", F.octet_length("header") + 1, F.col("payload_bytes").cast("int"))
    return records.select(
        "page_id", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), "record_type", "refers_to",
        "verified", F.sha2("record", 256).alias("record_sha256"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, payload, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d),
r AS (SELECT *, n >= 100 AND page_id <> first_id AS again FROM f),
h AS (SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END
  || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
  || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
  || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || digest
  || CASE WHEN again THEN chr(13) || chr(10) || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest'
     || chr(13) || chr(10) || 'WARC-Refers-To: <urn:page:' || first_id || '>' ELSE '' END
  || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || n
  || chr(13) || chr(10) || chr(13) || chr(10) AS header FROM r)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to, TRUE AS verified,
  sha256(encode(header) || payload || encode(chr(13) || chr(10) || chr(13) || chr(10))) AS record_sha256
FROM h
"""
